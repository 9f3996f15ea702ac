"""Counts of small hand-made inputs, with every figure worked out by hand."""

import pytest
from pyspark.sql import functions as F

from hitloom.compat import Compat
from hitloom.operators import count, gene, quant

COMBOS = [("s", ["txA"], 10), ("s", ["txA", "txB"], 6), ("s", ["txB", "txC"], 5)]
ANNOTATION = [("txA", "g1", 1000, 2000), ("txB", "g1", 1100, 2000), ("txC", "g2", 1200, 1200), ("txD", "g3", 1300, 1300)]


@pytest.fixture(scope="module")
def combos(spark):
    return spark.createDataFrame(COMBOS, "sample_id string, ids array<string>, n long")


@pytest.fixture(scope="module")
def annotation(spark):
    return spark.createDataFrame(ANNOTATION, "txname string, genename string, txlength int, geneeffectivelength int")


def as_dict(df, *values):
    values = values or ("n",)
    return {r.key: r[values[0]] if len(values) == 1 else tuple(r[v] for v in values) for r in df.collect()}


def test_isoform_rescue(combos, annotation):
    lengths = count.lengths_of(annotation)
    tpm = count.weights(count.unique(combos), lengths)
    assert as_dict(count.multi_em(combos, tpm)) == {"txA": 6}
    assert as_dict(count.multi_em_unallocated(combos, tpm)) == {"txB,txC": 5}
    assert as_dict(count.final_em(combos, lengths)) == {"txA": 16}
    assert as_dict(count.multi_equal(combos)) == {"txA": 3, "txB": 5.5, "txC": 2.5}
    assert as_dict(count.final_eq(combos)) == {"txA": 13, "txB": 5.5, "txC": 2.5}


def test_gene_rescue(combos, annotation):
    c = gene.classified(combos, gene.transcripts_to_genes(annotation))
    lengths = gene.gene_lengths(annotation)  # no longest-transcript column: the greatest txlength
    assert as_dict(gene.unique_to_gene(c)) == {"g1": 16}
    assert as_dict(gene.unique_split(c, combos), "and_isoform", "but_not_isoform") == {"g1": (16, 0)}
    assert as_dict(gene.first_id(c)) == {"g1": 21}
    assert [(r.ids, r.n) for r in gene.gene_combinations(c).collect()] == [(["g1", "g2"], 5)]
    assert as_dict(gene.multi_em(c, lengths)) == {"g1": 5}
    assert as_dict(gene.multi_equal(c)) == {"g1": 2.5, "g2": 2.5}
    assert as_dict(gene.final_em(c, lengths)) == {"g1": 21}
    assert as_dict(gene.final_eq(c)) == {"g1": 18.5, "g2": 2.5}
    assert as_dict(gene.final_ma(c)) == {"g1": 16}
    assert as_dict(gene.final_ma(c, Compat.corrected())) == {"g1": 21, "g2": 5}
    ratios = as_dict(gene.ratios(c, lengths), "multi_equal_ratio", "multi_em_ratio")
    assert ratios["g1"] == (pytest.approx(2.5 / 18.5), pytest.approx(5 / 21)) and ratios["g2"] == (1.0, None)


def test_repeated_names_lose_share(spark):
    c = spark.createDataFrame([("s", ["A", "A"], 4), ("s", ["A"], 1)], "sample_id string, ids array<string>, n long")
    lengths = spark.createDataFrame([("A", 1000.0)], "key string, length double")
    assert as_dict(count.multi_equal(c)) == {"A": 2.0}
    assert as_dict(count.multi_em(c, count.weights(count.unique(c), lengths))) == {"A": 2.0}
    assert as_dict(count.multi_to_all(c)) == {"A": 8}


def test_sums_are_kept(spark, sf_dir):
    from hitloom.plans import inputs

    c = inputs.combos(spark, sf_dir).where(F.size("ids") == F.size(F.array_distinct("ids")))
    total = c.agg(F.sum("n")).first()[0]
    lengths = inputs.tx_lengths(spark, sf_dir)
    tpm = count.weights(count.unique(c), lengths)
    assert count.final_eq(c).agg(F.sum("n")).first()[0] == pytest.approx(total)
    lost = count.multi_em_unallocated(c, tpm).agg(F.sum("n")).first()[0] or 0
    assert count.final_em(c, lengths).agg(F.sum("n")).first()[0] + lost == pytest.approx(total)
    for r in tpm.groupBy("sample_id").agg(F.sum("tpm").alias("t")).collect():
        assert r.t == pytest.approx(1e6)


def test_dirty_records(spark):
    rows = [("s", None), ("s", []), ("s", [None, " "]), ("s", [" A\r", None, "A"]), ("s", ["A"]), (None, ["A"])]
    c = count.combinations(spark.createDataFrame(rows, "sample_id string, ref_names array<string>"))
    assert {(r.sample_id, tuple(r.ids)): r.n for r in c.collect()} == {("s", ("A", "A")): 1, ("s", ("A",)): 1, (None, ("A",)): 1}
    empty = count.combinations(spark.createDataFrame([], "sample_id string, ref_names array<string>"))
    assert count.final_eq(empty).count() == 0 and count.multi_equal(empty).count() == 0


def test_tpm_falls_back_to_the_length(spark):
    a = spark.createDataFrame([("g1", 1000, 0), ("g2", 2000, 1500)], "genename string, genelongesttxlength int, geneeffectivelength int")
    counts = spark.createDataFrame([("s", "g1", 10.0), ("s", "g2", 5.0), ("s", "g3", None)], "sample_id string, key string, n double")
    e = {r.key: r for r in quant.expression(counts, quant.length_maps(a, "gene")).collect()}
    assert e["g1"].tpm == pytest.approx(750_000) and e["g2"].tpm == pytest.approx(250_000)
    assert e["g3"].tpm == 0 and e["g3"].rpkm == 0 and e["g1"].rpkm == pytest.approx(10 / 1.0 / 15e-6)


def test_matrix_and_layouts(spark):
    e = spark.createDataFrame([("a", "g1", 1.0, 10.0, 10.0, 5.0, 6.0), ("b", "g2", 2.0, 20.0, 15.0, 7.0, 8.0)], "sample_id string, key string, n double, length double, eff_length double, tpm double, rpkm double")
    m = {r.key: r.asDict() for r in quant.sample_matrix(e).collect()}
    assert m["g1"] == {"key": "g1", "a_count": 1.0, "b_count": 0.0, "a_tpm": 5.0, "b_tpm": 0.0}
    assert quant.export_featurecounts(e).columns == ["sample_id", "Geneid", "Length", "Count"]
    assert quant.FORMATS["multi"] == ("salmon", "kallisto", "featureCounts") and set(quant.FORMATS["all"]) == set(quant.EXPORTERS)
    assert quant.count_types("all", ["raw", "Final_EM"]) == ["raw", "Final_EM"] and quant.count_types(None, []) == ["Final_EM"] and quant.count_types("a, b", []) == ["a", "b"]


def test_matrix_of_all_samples(spark, sf_dir):
    from hitloom.plans import counting, inputs

    m = counting.queries()["sample_matrix_all"](spark, sf_dir)
    samples = {r[0] for r in inputs.read(spark, sf_dir, "fanse_record").select("sample_id").distinct().collect()}
    assert set(m.columns) == {"key"} | {f"{s}_{v}" for s in samples for v in ("count", "tpm", "rpkm")} and len(samples) > len(counting.SAMPLES)
    assert all(any(r[c] for c in m.columns if c.endswith("_count")) for r in m.collect())  # no key is without a sample
