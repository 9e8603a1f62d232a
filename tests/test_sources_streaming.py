import json

from tuplewright.plans.engine import Engine, evaluate
from tuplewright.plans import analyses as A
from tuplewright.sources import facts as S
from tuplewright.sources import sinks
from tuplewright.streaming.incremental import FactStream, sessions, windowed_counts


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_facts_round_trip_missing_extra_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("a.B", "x\ty", 'say "hi"', "int"), ("<C: f>", "C", "f", "C")], S.SCHEMAS["java"]["Field"])
    S.write(df, str(tmp_path), "Field")
    got = rows(S.read(spark, str(tmp_path), "Field"))
    assert len(got) == 2 and got[0] == ("<C: f>", "C", "f", "C") and "\t" not in got[1][1]
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "FormalParam.facts").write_text("0\tm\tp\n1\tm\tq\n0\tm\tp\n")
    (tmp_path / "extra").mkdir()
    (tmp_path / "extra" / "FormalParam.facts").write_text("2\tm\tr\n")
    made = []

    def make():
        made.append(1)
        return S.read_all(spark, str(tmp_path / "plain"), extra=str(tmp_path / "extra"), only=["FormalParam", "ThisVar", "Method-Modifier"])

    key = S.cache_key(["app.jar"], {"platform": "java_8"})
    for _ in range(2):
        all_ = S.cached(spark, str(tmp_path / "cache"), key, make)
        assert rows(all_["FormalParam"]) == [(0, "m", "p"), (1, "m", "q"), (2, "m", "r")] and rows(all_["ThisVar"]) == [] and "Method_Modifier" in all_
    assert made == [1] and key != S.cache_key(["app.jar"], {"platform": "java_7"})
    normal = A.normalise(spark, all_)
    assert set(normal) == set(A.NORMAL) and rows(normal["formal"]) == [("m", 0, "p"), ("m", 1, "q"), ("m", 2, "r")]


def test_script_and_binary_schemas_are_whole():
    assert S.SCHEMAS["java"]["AssignHeapAllocation"].names == ["instruction", "index", "heap", "to", "inmethod", "linenumber"]
    assert S.SCHEMAS["script"]["AssignHeapAllocation"].names == ["instruction", "index", "heap", "to", "inFunction"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    sinks.export({"edge": df}, str(tmp_path), "csv")
    assert rows(spark.read.csv(f"{tmp_path}/edge.csv", sep="\t")) == [("a", "b"), ("a", "c")]
    result = evaluate(spark, ".decl edge(a: symbol, b: symbol) .input edge .decl r(a: symbol) r(x) :- edge(x, _).", {"edge": spark.read.csv(f"{tmp_path}/edge.csv", sep="\t")}, "r")
    assert rows(result["r"]) == [("a",)] and rows(sinks.sizes(spark, {"edge": df, "r": result["r"]})) == [("edge", 2), ("r", 1)]
    findings = spark.createDataFrame([("leak", "a to b", "A.java", 3), ("leak", "c", "B.java", 0)], "rule string, message string, file string, line int")
    sinks.write_sarif(findings, str(tmp_path / "sarif"))
    log = json.loads(sinks.read_sarif(spark, str(tmp_path / "sarif")))
    assert len(log["runs"][0]["results"]) == 2 and log["version"] == "2.1.0"
    directives = spark.createDataFrame([("keep", "C", "m"), ("keep", "C", "a"), ("inline", "C", "z")], "kind string, type string, member string")
    (row,) = sinks.json_config(directives).collect()
    assert json.loads(row.json) == {"name": "C", "directives": {"inline": ["z"], "keep": ["a", "m"]}}
    clock = sinks.Clock()
    with clock.phase("facts"):
        pass
    assert [r.phase for r in clock.table(spark).collect()] == ["facts"]


def test_stream_of_facts_equals_batch(spark, tmp_path):
    text = ".decl edge(a: symbol, b: symbol) .decl path(a: symbol, b: symbol) path(x, y) :- edge(x, y). path(x, z) :- path(x, y), edge(y, z)."
    schema = "a string, b string"
    parts = [[("a", "b"), ("b", "c")], [("c", "d")], [("d", "a"), ("a", "b")]]
    engine = Engine(spark, text, {"edge": spark.createDataFrame([], schema)})
    engine.run("path")
    deltas = []
    stream = FactStream(engine, "edge", lambda r, df, n: deltas.append(r))
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "checkpoint"), available_now=True)
        q.awaitTermination()
        assert len(stream.found) == i + 1
    whole = evaluate(spark, text, {"edge": spark.createDataFrame(sum(parts, []), schema)}, "path")
    assert rows(engine.relation("path")) == rows(whole["path"]) and len(rows(whole["path"])) == 16 and "path" in deltas


def test_event_windows(spark):
    e = spark.createDataFrame([(1, "2024-01-01 00:01:00", "a"), (1, "2024-01-01 00:04:00", "a"), (1, "2024-01-01 01:00:00", "b")], "user_id long, ts string, event_type string").withColumn("ts", __import__("pyspark").sql.functions.to_timestamp("ts"))
    assert sorted((r.event_type, r.n) for r in windowed_counts(e).collect()) == [("a", 2), ("b", 1)]
    assert sorted((r.user_id, r.n) for r in sessions(e).collect()) == [(1, 1), (1, 2)]
