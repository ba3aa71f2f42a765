"""Individual means and rates of many samples: what is sent where, and missing keys on the way."""

import pytest

from catalog.registry import QUERIES, snapped
from lakesurvey.operators import rates
from lakesurvey.operators.joins import name_missing, unname_missing

TAXON_STAGE = list(rates.TAXON_STAGE)
TAXA = "Genus_sp_lifestage string, Life_stage string, Biom_a double, Biom_b double, Biom_dens double, FR1_a double, FR1_b double, Pr_alpha double, Pr_beta double, Pr_rho double"
THRESHOLDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder(spark, tmp_path):
    """Sixty samples of four line items over ten parts; some parts of line items and a part's own key are missing."""
    orders = [(o, o % 7, "F", 10.0, "1996-05-01", "low") for o in range(60)]
    items = [(o, None if o % 9 == 0 else (o + n) % 10, o % 5, n, float(n + 1), 7.0, 0.1, 0.2) for o in range(60) for n in range(4)]
    parts = [(p if p < 9 else None, "name", "brand", "MEDIUM", p) for p in range(10)]
    for name, rows, schema in (
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"),
        ("lineitem", items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double"),
        ("part", parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def unbroadcast(spark, folder, name):
    """A query's frame, planned and collected without broadcasts."""
    spark.conf.set(THRESHOLDS[0], "-1")
    df = QUERIES[name](spark, folder)
    adaptive = spark.conf.get(THRESHOLDS[1])
    spark.conf.set(THRESHOLDS[1], "-1")
    try:
        return plan_of(df), sorted(map(str, df.collect()))
    finally:
        spark.conf.unset(THRESHOLDS[0])
        spark.conf.set(THRESHOLDS[1], adaptive)


@pytest.mark.parametrize("name", ["d11_stage_means", "d12_volumetric_rates"])
def test_lengths_are_grouped_where_they_lie(spark, folder, name):
    df = QUERIES[name](spark, folder)
    plan, got = unbroadcast(spark, folder, name)
    # Grouped by sample, taxon and stage before they are sent, single lengths would travel as wide sums.
    for text in (plan_of(df), plan):
        assert "Exchange hashpartitioning(Sample_ID" in text and "hashpartitioning(Sample_ID#" in text
        for line in text.splitlines():
            assert "Exchange hashpartitioning(Sample_ID" not in line or "REPARTITION_BY" in line, line
    assert sorted(map(str, df.collect())) == got
    assert len(got) == (240 if name.startswith("d12") else df.select("Sample_ID", *TAXON_STAGE).distinct().count())


def test_missing_taxa_keep_their_coefficients(spark, folder):
    # The part without a key gives the taxon without a name; its size is 9: Biom_a 1.4, Biom_b 2.0.
    rows = QUERIES["d11_stage_means"](spark, folder).filter("Genus_sp_lifestage IS NULL AND Life_stage = 'Older' AND Sample_ID = '9'").collect()
    lengths = [2 * 0.185, 4 * 0.185]
    assert len(rows) == 1 and rows[0].mean_mass == pytest.approx(sum(1.4 * x**2 for x in lengths) / 2, abs=1e-4)


def test_missing_keys_get_a_name_and_back(spark, rows):
    values = [None, "", "\0", "\0\0", "\0a", "a", "a\0"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "k string, n int")
    named = name_missing(df, ["k"])
    assert named.schema["k"].nullable is False and named.select("k").distinct().count() == len(values)
    assert {r.n: r.k for r in unname_missing(named, ["k"]).collect()} == dict(enumerate(values))


def test_rates_by_named_keys_are_those_by_missing_ones(spark, rows):
    keys = [(s, t, g) for s in ("1", "2", None) for t in ("T1", "T21_veligers", None) for g in ("Older", "Egg", None)]
    lengths = spark.createDataFrame([(*k, 0.5 + n % 7) for n, k in enumerate(keys * 3)], "Sample_ID string, Genus_sp_lifestage string, Life_stage string, Length_mm double")
    counts = spark.createDataFrame([(*k, float(n), 20.0) for n, k in enumerate(keys + keys[:4])],
                                   "Sample_ID string, Genus_sp_lifestage string, Life_stage string, Zoop_density double, Surface_temp double")
    taxa = spark.createDataFrame([(t, g, 1.0 + n, 2.0, d, 0.5, None if t is None else 1.0, 0.1, 0.9, 1.05)
                                  for t in ("T1", None) for g in ("Older", None) for n, d in ((0, None), (1, 0.3))], TAXA)

    def rated(lengths, counts, taxa, **options):
        means = rates.stage_means(rates.individual_rates(lengths, taxa, veliger_taxon="T21_veligers", **options), ["Sample_ID"])
        return rates.volumetric_rates(counts, means, taxa, ["Sample_ID"], **options)

    plain = rated(lengths, counts, taxa)
    named = rated(*(name_missing(df, TAXON_STAGE) for df in (lengths, counts, taxa)), null_keys=False)
    # Means are sums in any order: compared on the grid of the checked queries.
    assert rows(snapped(unname_missing(named, TAXON_STAGE).select(*plain.columns))) == rows(snapped(plain))
    assert plain.count() > counts.count()
