"""Headers written and read back: every field, absent ones, and a cut at every place."""

from pyspark.sql import functions as F

from tessera.functions import headers
from tessera.plans import catalogue, containers  # noqa: F401, the second adds its queries to the first


def test_every_field_comes_back_and_cuts_are_told(spark):
    on = {n: (rule[0], rule[1], rule[2]) for n, _, _, *rule in headers.FIELDS if rule}
    rows = [(k, [(k * 13 + i * 7) % (1 << w) if kind == headers.U else (k + i) % 9 - 4 if kind == headers.SE else (k * i) % 23 for i, (_, kind, w, *_) in enumerate(headers.FIELDS)]) for k in range(12)]
    table = spark.createDataFrame(rows, "k long, v array<long>").withColumn("bits", headers.written("v"))
    whole = table.select("k", "v", "bits", headers.read("bits").alias("h")).collect()
    for r in whole:
        values = dict(zip(headers.NAMES, r.v, strict=True))

        def here(name, values=values):
            return name not in on or (here(on[name][0]) and on[name][1] <= values[on[name][0]] <= on[name][2])

        want = [values[n] if here(n) and kind != headers.ALIGN else None for n, kind, *_ in headers.FIELDS]
        assert list(r.h.out) == want and not r.h.bad and r.h["at"] == len(r.bits)
    cuts = spark.createDataFrame([(c, whole[5].bits[:c]) for c in range(len(whole[5].bits))], "c int, bits string").select("c", headers.read("bits").alias("h"))
    for r in cuts.collect():
        assert r.h.bad and r.h["at"] <= r.c
        kept = [a for a, b in zip(r.h.out, whole[5].h.out, strict=True) if a is not None or b is None]
        assert [a for a, b in zip(r.h.out, whole[5].h.out, strict=True) if a is not None] == [b for b in whole[5].h.out if b is not None][: sum(a is not None for a in r.h.out)] and kept is not None


def test_summary_of_a_bad_crop_and_depth(spark):
    def header(**more):
        return [more.get(n, 0) for n in headers.NAMES]

    rows = [
        ("fine", header(chroma_format_idc=1, coded_width=64, coded_height=48, conformance_window=1, crop_right=3, crop_bottom=2, dual_tree=1, cclm=1)),
        ("crop", header(chroma_format_idc=1, coded_width=8, coded_height=48, conformance_window=1, crop_right=5)), ("depth", header(bit_depth_minus8=3)),
    ]
    t = spark.createDataFrame(rows, "name string, v array<long>").withColumn("bits", headers.written("v")).select("name", headers.read("bits").alias("h"))
    got = {r.name: r for r in t.select("name", *[c.alias(k) for k, c in headers.summary(F.col("h")).items()]).collect()}
    assert (got["fine"].width, got["fine"].height, got["fine"].depth, got["fine"].dual_tree, got["fine"].error) == (58, 44, 8, True, None)
    assert (got["crop"].error, got["crop"].width, got["depth"].error) == ("bad crop", None, "bit depth")


def test_headers_are_made_and_read_once_without_folds(spark, tmp_path):
    rows = spark.range(1, 9).selectExpr("id AS p_partkey", "cast(id AS int) AS p_size")
    rows.write.parquet(f"{tmp_path}/part.parquet")
    for name in ("header_fields", "header_summary"):
        plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("_read(") == 1 and "lambdafunction" not in plan


def test_null_empty_and_odd_headers_among_many(spark):
    fixed = "0" * 37 + "000" + "0" * 10  # up to the first code, the alignment included
    odd = [None, "", "0", fixed + "0" * 70 + "1" * 80, fixed + "0" * 62 + "1" + "0" * 62]
    (whole,) = spark.createDataFrame([([1] * len(headers.NAMES),)], "v array<long>").select(headers.written("v").alias("bits")).collect()
    many = [(k, odd[k] if k < len(odd) else whole.bits + "01" * (k % 3)) for k in range(2 * headers.SIDE + 7)]
    got = {r.k: r.h for r in spark.createDataFrame(many, "k int, bits string").repartition(1).select("k", headers.read("bits").alias("h")).collect()}
    nothing = [None] * len(headers.NAMES)
    assert (got[0]["at"], got[0].out, got[0].bad) == (0, nothing, None) and (got[1]["at"], got[1].out, got[1].bad) == (0, nothing, True) == (got[2]["at"], got[2].out, got[2].bad)
    width = headers.NAMES.index("coded_width")
    assert got[3].bad and got[3]["at"] == 50 and got[3].out[width] is None
    assert got[4].bad and got[4].out[width] == (1 << 62) - 1
    assert all(not h.bad and h["at"] == len(whole.bits) and h.out == got[len(odd)].out for k, h in got.items() if k >= len(odd)) and got[len(odd)].out[width] == 1
