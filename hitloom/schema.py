"""Schemas of the tables that readers give and operators take."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: One row per read, with parallel arrays per hit.
RECORD = _struct(
    file_name=_S, record_no=_L, header=_S, seq=_S, alignment=T.ArrayType(_S), strands=T.ArrayType(_S), ref_names=T.ArrayType(_S), mismatches=T.ArrayType(_I), positions=T.ArrayType(_L), multi_count=_I
)
UNMAPPED = _struct(read_id=_S, sequence=_S)
FASTX = _struct(header=_S, seq=_S, qual=_S, record_no=_L)
REFERENCE = _struct(ref_name=_S, seq=_S, length=_I, ref_ord=_L)
SAM = _struct(line_no=_L, qname=_S, flag=_I, rname=_S, pos=_L, mapq=_I, cigar=_S, rnext=_S, pnext=_L, tlen=_L, seq=_S, qual=_S, tags=T.ArrayType(_S))
FEATURE = _struct(line_no=_L, seqid=_S, source=_S, feature=_S, start=_L, end=_L, score=_S, strand=_S, phase=_S, attributes=_S)

# Columns of the annotation files, in file order. In the files the gene id is "geneName" and the display name
# "genename"; as names here don't differ by case alone, they are genename and symbol, all in lower case.
REFFLAT_COLUMNS = (
    "genename txname chrom strand txstart txend cdsstart cdsend exoncount exonstarts exonends symbol g_biotype t_biotype protein_id txlength "
    "isoformeffectivelength cdslength utr5length utr3length genelongesttxlength genelongestcdslength geneeffectivelength genenonoverlaplength genereadcoveredlength description"
).split()
REFFLAT_FILE_NAMES = {"genename": "geneName", "symbol": "genename"} | {
    c.lower(): c
    for c in (
        "txStart txEnd cdsStart cdsEnd exonCount exonStarts exonEnds txLength isoformEffectiveLength cdsLength utr5Length utr3Length "
        "genelongesttxLength genelongestcdsLength geneEffectiveLength geneNonOverlapLength geneReadCoveredLength"
    ).split()
}
REFFLAT_DEFAULT = (
    "genename txname chrom strand txstart txend cdsstart cdsend exoncount exonstarts exonends symbol g_biotype t_biotype description protein_id txlength "
    "cdslength utr5length utr3length genelongesttxlength genelongestcdslength geneeffectivelength genenonoverlaplength genereadcoveredlength"
).split()
REFFLAT_INTS = frozenset(c for c in REFFLAT_COLUMNS if c.endswith(("start", "end", "length", "count")))
