"""Switches between the behaviour users rely on today and the corrected one."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Compat:
    """``Compat()`` keeps today's numbers; ``Compat.corrected()`` mends all known defects."""

    #: NM of every row of a record is that of its last hit; corrected, of the row's own hit.
    nm_of_last_hit: bool = True
    #: Strands in SA tags are F and R; corrected, + and -.
    sa_strand_letters: bool = True
    #: Exons of minus-strand transcripts keep genomic order in RNA coordinates; corrected, they are reversed.
    rna_keeps_genomic_order: bool = True
    #: Pileup bases are those of the read as sequenced; corrected, reverse hits are complemented.
    pileup_as_sequenced: bool = True
    #: ``chr:s-`` is no region; corrected, it runs to the end.
    open_region_ignored: bool = True
    #: Without any valid region nothing is filtered; corrected, everything is.
    no_region_keeps_all: bool = True
    #: Exon rows of the unified RNA track have genomic coordinates; corrected, those on the RNA.
    unified_exons_genomic: bool = True
    #: The gene level has no count-all part in Final_MA; corrected, it has.
    gene_final_ma_without_multi: bool = True

    @classmethod
    def corrected(cls) -> Compat:
        return cls(*[False] * 8)
