import re

from pyspark.sql import functions as F

from grantmill import dims
from grantmill.functions import text
from grantmill.operators import inequality, inference, metrics, profile, ranking, sampling
from grantmill.sources import files


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first().y


def test_industry_pattern_in_spark_and_python(spark):
    yes = ["Industria 4.0", "industria-4.0", "TRANSIZIONE 4.0", "impresa 4 . 0", "piano nazionale industria 4.0", "Industria.4.0", "industria4.0"]
    no = ["versione 4.0", "release 4.0", "industria alimentare", "transizione ecologica", ""]
    rows = spark.createDataFrame([(x,) for x in [*yes, *no, None]], "x string").select("x", text.matches_any(["x"], dims.INDUSTRY_40, dims.INDUSTRY_WORDS).alias("y")).collect()
    got = {r.x: r.y for r in rows}
    assert all(got[x] for x in yes)
    assert not any(got[x] for x in [*no, None])
    assert all(bool(re.search(dims.INDUSTRY_40, x, re.I)) == got[x] for x in [*yes, *no])


def test_unicode_patterns(spark):
    assert _one(spark, "La REALTÀ aumentata", lambda c: text.matches(c, r"\brealtà\b"))
    assert not _one(spark, "perché", lambda c: text.matches(c, r"\bperch\b"))


def test_labels_and_literals(spark):
    assert _one(spark, "['Deep-Learning' \"x\", 'x']", text.parse_list_literal) == "deep learning|x"
    assert _one(spark, None, text.parse_list_literal) == ""
    assert _one(spark, "<think>a\nb</think> Enterprise", text.strip_reasoning) == "Enterprise"
    assert _one(spark, "<think>never closed", text.strip_reasoning) == ""
    assert _one(spark, "```json\n{}\n```", text.strip_fence) == "{}"
    labels = ["Research", "Research & use", "Fintech"]
    assert _one(spark, "rEsearch", lambda c: text.resolve_label(c, labels)) == "Research"
    assert _one(spark, "it is research & use, no fintech", lambda c: text.resolve_label(c, labels)) == "Research & use"
    assert _one(spark, "what", lambda c: text.resolve_label(c, labels)) == "UNKNOWN_what"
    assert _one(spark, "Robotics AI", lambda c: text.lookup(c, dims.UNIFIED_LABELS)) == "Robotics and Industry"
    assert _one(spark, "Data Science", lambda c: text.lookup(c, dims.UNIFIED_LABELS)) is None
    assert _one(spark, "Z", lambda c: text.lookup(c, dims.SECTIONS, "Altro")) == "Altro"
    assert _one(spark, "c", lambda c: text.lookup(c, {"a": "b"}, ...)) == "c"
    assert _one(spark, "a chatbot", lambda c: text.first_match(c, {"A": [r"\bx\b"], "B": [r"\bchatbot\b"]}, "R")) == "B"


def test_cleaning(spark):
    assert _one(spark, 'à "b",\n c;d', text.clean_ascii) == "b c d"
    assert _one(spark, "2014-06-30+02:00", text.strip_tz) == "2014-06-30"
    assert _one(spark, "Lazio|Lazio, Umbria  Lazio", text.multi_normalise) == "Lazio|Umbria"
    assert _one(spark, None, text.bucket_beneficiary) == "Altro"
    assert _one(spark, " piccola ", text.bucket_beneficiary) == "PMI"
    assert _one(spark, "Does x..", lambda c: text.template_variants(c, ["We %s!"])) == ["Does x..", "We does x!"]


def test_gini_and_lorenz(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (0.0,), (-5.0,), (None,)], "v double")
    v = [1, 1, 2]
    want = (2 * sum((i + 1) * x for i, x in enumerate(v)) - 4 * sum(v)) / (3 * sum(v))
    assert abs(inequality.gini(df, "v").first().gini - want) < 1e-12
    assert inequality.gini(df.where("v > 9"), "v").first().gini == 0.0
    points = sorted((round(r.x, 6), round(r.y, 6)) for r in inequality.lorenz(df, "v").collect())
    assert points == [(0.0, 0.0), (0.666667, 0.5), (1.0, 1.0)]


def test_sampling_is_exact_and_repeats(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).cast("string").alias("g"))
    capped = sampling.stratified_cap(df, "g", 10, "id")
    assert [r["count"] for r in capped.groupBy("g").count().collect()] == [10, 10, 10]
    one = {r.id for r in sampling.sample_n(df, 50, "id").collect()}
    assert one == {r.id for r in sampling.sample_n(df.repartition(7), 50, "id").collect()} and len(one) == 50
    split = sampling.train_test_split(df, "id")
    assert split.where("is_test").count() == 100
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "id int, t string")
    assert {r.id for r in sampling.dedup(rows, ["t"], ["id"]).collect()} == {1, 3}
    assert {r.id for r in sampling.dedup(rows, ["t"], ["id"], "last").collect()} == {2, 4}


def test_metrics_with_nulls_and_empty(spark):
    df = spark.createDataFrame([(True, True), (True, False), (None, True), (False, False)], "t boolean, p boolean")
    r = metrics.binary_report(df, "t", "p").first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall) == (1, 1, 1, 1, 0.5, 0.5)
    empty = metrics.binary_report(df.where("false"), "t", "p").first()
    assert (empty.accuracy, empty.f1) == (0.0, 0.0)


def test_inference_slot(spark):
    df = spark.createDataFrame([(1, "AI for all"), (2, None)], "id int, text string")
    assert [r.prediction for r in inference.classify(df, "text").orderBy("id").collect()] == ["ai", "non_ai"]

    def broken(_):
        raise OSError

    assert {r.prediction for r in inference.classify(df, "text", broken).collect()} == {"ERROR_MAX_RETRIES"}
    assert [r.id for r in inference.pending(df, df.where("id = 1"), "id").collect()] == [2]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("001", 'a "b",\nc', 2014), ("2", "NA", 2015)], "cf string, t string, y int")
    files.write_csv(df, str(tmp_path / "csv"), quote_all=True)
    back = files.read_csv(spark, str(tmp_path / "csv"), files.strings(["cf", "t", "y"]))
    assert sorted((r.cf, r.t, r.ANNO) for r in back.collect()) == [("001", 'a "b",\nc', None), ("2", None, None)]
    (tmp_path / "x_2019.csv").write_text("cf\n7\n")
    assert files.read_csv(spark, str(tmp_path / "x_2019.csv"), files.strings(["cf"])).first().ANNO == 2019
    files.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.schema("cf string, y int").json(str(tmp_path / "j")).count() == 2
    for c in ("ai", "non_ai"):
        (tmp_path / "texts" / c).mkdir(parents=True)
        (tmp_path / "texts" / c / "a.txt").write_text(f" text {c}\n")
    assert sorted((r.label, r.text) for r in files.read_text_dirs(spark, str(tmp_path / "texts")).collect()) == [("ai", "text ai"), ("non_ai", "text non_ai")]


def test_stream_equals_batch(spark, tmp_path):
    from grantmill.streaming.windows import tumbling

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("tumbled").collect())) == sorted(map(key, tumbling(events).collect()))


def test_row_numbers_over_parts(spark):
    df = spark.createDataFrame([(i, None if i % 50 == 0 else float(i * i % 97), "ab"[i % 2] if i % 7 else None) for i in range(500)], "id int, v double, g string")
    order = [F.col("v").asc_nulls_first(), "id"]
    rows = sorted(df.collect(), key=lambda r: (-1.0 if r.v is None else r.v, r.id))
    for parts in (1, 2, 9):
        got = {r.id: r.n for r in ranking.row_numbers(df, order, F.col("v"), "n", parts=parts).collect()}
        assert got == {r.id: i + 1 for i, r in enumerate(rows)}
        by = {r.id: r.n for r in ranking.row_numbers(df, order, F.col("v"), "n", ["g"], parts).collect()}
        assert by == {r.id: i + 1 for g in ("a", "b", None) for i, r in enumerate(x for x in rows if x.g == g)}
    assert ranking.row_numbers(df.where("false"), order, F.col("v"), "n").count() == 0


def test_gini_of_groups(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("b", 3.0), ("c", -1.0), (None, 2.0), (None, 2.0)], "g string, v double")
    got = {r.g: r.gini for r in inequality.gini(df, "v", ["g"]).collect()}
    assert got["a"] is None and abs(got["b"] - 0.25) < 1e-12 and abs(got[None]) < 1e-12 and "c" not in got


def test_texts_of_the_library(spark):
    assert _one(spark, "Perch\u00e9 no, l'AI 4.0 perch\u00e9", lambda c: text.words(c, 2, ["no"])) == ["perch\u00e9", "perch\u00e9"]
    assert _one(spark, "a\u00e0\U0001f600", text.non_ascii_chars) == ["\u00e0", "\U0001f600"]
    seven = _one(spark, "Does x..", lambda c: text.template_variants(c, dims.USE_CASE_TEMPLATES, F.lit("health")))
    assert len(seven) == 7 and seven[0] == "Does x.." and seven[1].endswith(" does x") and seven[5].startswith("Does x. ") and seven[6].startswith("A health ")
    assert _one(spark, None, lambda c: text.template_variants(c, dims.USE_CASE_TEMPLATES, F.lit("x"))) is None
    labels = F.array(F.lit("NLP"), F.lit("slam"), F.lit(None).cast("string"), F.lit("odd"))
    assert spark.range(1).select(text.map_labels(labels, {"Text": ["nlp"], "Moves": ["SLAM"]}, "Other").alias("y")).first().y == ["Moves", "Other", "Text"]


def test_reports(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c"), (None, "a")], "t string, p string")
    rows = [tuple(r) for r in metrics.confusion_matrix(df, "t", "p", ["c", "a", "b"]).orderBy("place").collect()]
    assert rows == [(0, "c", 0, 0, 0), (1, "a", 0, 1, 1), (2, "b", 1, 0, 1)]
    report = metrics.class_report(df.where("t is not null and p <> 'c'"), "t", "p")
    avg = {r.label: r for r in metrics.averages(report).collect()}
    assert abs(avg["macro avg"].precision - 0.75) < 1e-12 and abs(avg["weighted avg"].recall - 2 / 3) < 1e-12 and avg["macro avg"].support == 3
    for x, dof, p in [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (24.995790, 15, 0.05), (0.0, 4, 1.0)]:
        assert abs(metrics.chi_square_tail(x, dof) - p) < 1e-6
    one = metrics.chi_square(df.where("false"), "t", "p").first()
    assert (one.chi2, one.dof, one.p) == (0.0, 0, 1.0)


def test_profiles(spark):
    df = spark.createDataFrame([("x", 1), (None, 1), ("\u00e8\u00e8", None)], "`a.b` string, n int")
    assert [tuple(r) for r in profile.profile(df).collect()] == [("a.b", "string", 2, 1, 100 / 3, 2), ("n", "int", 2, 1, 100 / 3, 1)]
    assert [tuple(r) for r in profile.length_audit(df, 1).collect()] == [("a.b", 2, 1, 0.5)]
    assert profile.profile(df.where("false")).first().null_pct == 0.0
    assert {r.check: r.broken for r in profile.label_checks(df, "`a.b`", ["x", "y"], 1).collect()} == {"label not allowed": 2, "label missing": 1, "over the cap": 0}


def test_sources_that_miss_or_differ(spark, tmp_path):
    (tmp_path / "a_2020.csv").write_text("id,t\n1,caff\u00e8\n", encoding="latin-1")
    (tmp_path / "a_2021.csv").write_text("id,t\n2,caff\u00e8\n", encoding="utf-8")
    schema = files.strings(["id", "t"])
    assert sorted((r.id, r.t, r.ANNO) for r in files.read_csv_any(spark, str(tmp_path), schema).collect()) == [("1", "caff\u00e8", 2020), ("2", "caff\u00e8", 2021)]
    got = files.read_years(spark, f"{tmp_path}/a_{{year}}.csv", [2019, 2021, 2022], schema, ["id"])
    assert got.columns == ["id", "ANNO"] and [tuple(r) for r in got.collect()] == [("2", 2021)]
    none = files.read_years(spark, f"{tmp_path}/a_{{year}}.csv", [1999], schema)
    assert none.columns == ["id", "t", "ANNO"] and none.count() == 0
    (tmp_path / "n.txt").write_text("t;id\nx;1\n;2\n")
    assert [tuple(r) for r in files.read_named(spark, str(tmp_path / "n.txt"), ["t", "label"], defaults={"label": "ai"}).collect()] == [("x", "ai", "n")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b;c\\d", 2020, "x"), (1, None, 2021, "x"), (3, "e", 2020, None)], "id int, t string, ANNO int, g string")
    files.write_unquoted(df.coalesce(1), str(tmp_path / "u"), sep=";")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "u")).collect()) == ["1;;2021;x", "2;b\\;c\\\\d;2020;x", "3;e;2020;"]
    files.write_config(spark, str(tmp_path / "c"), {"columns": df.columns, "n": 3})
    assert files.read_config(spark, str(tmp_path / "c")) == {"columns": df.columns, "n": 3}
    sizes = {r.part: (r.n, r.bytes > 0) for r in files.export_years(df, str(tmp_path / "e")).collect()}
    assert sizes == {"2020": (2, True), "2021": (1, True), "all": (3, True)}
    files.write_texts(df, str(tmp_path / "w"), "g", "t", "id")
    assert sorted(str(p.relative_to(tmp_path / "w")) for p in (tmp_path / "w").rglob("*.txt")) == ["none/none_desc_001.txt", "x/x_desc_001.txt", "x/x_desc_002.txt"]
    assert (tmp_path / "w/x/x_desc_002.txt").read_text() == "b;c\\d" and (tmp_path / "w/x/x_desc_001.txt").read_text() == ""


def test_answers_are_resumed(spark, tmp_path):
    df = spark.createDataFrame([(i, f"AI {i}") for i in range(40)] + [(3, "AI 3"), (None, "x")], "id int, text string")
    path, asked = str(tmp_path / "out"), spark.sparkContext.accumulator(0)

    def step(part):
        def client(texts):
            asked.add(len(texts))
            return ["ai"] * len(texts)

        return inference.classify(part, "text", client, concurrency=2, batch=3)

    def stops(part, seen=[]):  # noqa: B006
        seen.append(1)
        if len(seen) > 2:
            raise OSError("stopped")
        return step(part)

    try:
        inference.append_answers(df, path, "id", stops, 5)
    except OSError:
        pass
    done = spark.read.parquet(path).count()
    assert 0 < done < 40
    out = inference.append_answers(df, path, "id", step, 5)
    assert sorted(r.id for r in out.collect()) == list(range(40)) and asked.value == 40
    t = inference.throughput(out, seconds=2.0).first()
    assert (t.n, t.errors, t.per_second) == (40, 0, 20.0)


def test_minority_classes_grow(spark):
    df = spark.createDataFrame([("a", "x")] * 5 + [("b", "y"), ("b", "Same"), (None, "z")], "g string, t string")
    out = inference.augment_minority(df, "g", "t", lambda ts: [t if t == "Same" else t + "!" for t in ts], 3)
    assert sorted((r.g, r.t) for r in out.where("Is_Augmented").collect()) == [("b", "y!")] and out.count() == 9
    prompt = df.select(inference.few_shot_prompt("t", ["a", "b"], "Sort it.", [("q", "a")], 1).alias("p")).first().p
    assert prompt == "Sort it.\nAnswer with one of: a, b.\n\nText: q\nLabel: a\n\nText: x\nLabel:"
