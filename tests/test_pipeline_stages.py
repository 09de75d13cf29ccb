import json

from pyspark.sql import functions as F

from litmill import cli, pipeline
from litmill.operators.relations import project
from litmill.sources.schema import MANIFEST, RECORD, ddl
from litmill.streaming import ingest

TITLES = [
    "Biopsychosocial model of chronic low back pain: a systematic review", "A biopsychosocial view of fibromyalgia and family work: scoping review",
    "Biopsychosocial review of neuropathic pain", "Unrelated chemistry", "Biopsychosocial protocol for chronic pain review", "biopsychosocial chronic pain review of central sensitization, coping and stigma",
]


def own_clients():
    return {"enricher": lambda batch: json.dumps({"records": [{"record_id": r["record_id"], "review_type": "systematic review"} for r in batch]})}


def workspace(spark, root):
    rows = [(f"r{i}", t, "Objective: to see. METHODS: x", f"10.1/{i % 5 if i < 7 else i}", 2000 + i, ["Ames, A"]) for i, t in enumerate(TITLES * 4)]
    df = spark.createDataFrame(rows, "record_id string, title string, abstract string, doi string, year int, authors array<string>").withColumns({"database": F.lit("PubMed"), "query_key": F.lit("q"), "pmcid": F.concat(F.lit("PMC"), "record_id")})
    project(df, RECORD).write.parquet(f"{root}/records/a")
    m = spark.createDataFrame([("PubMed", "q", "l", None, None, None, len(rows), "records/a"), ("PubMed", "old", "l", None, None, None, 1, "records/missing")], ddl(MANIFEST))
    m.write.parquet(f"{root}/search_manifest")
    (root / "manual_imports").mkdir()
    (root / "manual_imports" / "own.ris").write_text("TY  - JOUR\nTI  - Biopsychosocial headache review\nPY  - 2001\nER  - \n")
    (root / "manual_imports" / "notes.txt").write_text("x")
    return pipeline.Workspace(spark, str(root), fetcher=lambda k: f"<a><body><p>{'word ' * 260}</p></body></a>")


def test_all_stages(spark, tmp_path):
    w = workspace(spark, tmp_path)
    out = pipeline.run_all(w, {"search-pubmed": lambda: {}["PUBMED_KEY"], "search-wos": lambda: 1 / 0})
    assert out["search-pubmed"]["status"] == "missing_credentials" and out["search-wos"]["status"] == "failed"
    assert out["dedupe"]["combined_records"] == 25 and out["dedupe"]["skipped"] == ["notes.txt"]
    assert out["dedupe"]["deduplicated_records"] + out["dedupe"]["duplicates_removed"] == 25
    assert sum(out["screen-stage1"].values()) == out["dedupe"]["deduplicated_records"]
    assert out["extract-stage2"] == {"stage2_records": out["screen-stage1"]["include"], "violations": 0} or out["extract-stage2"]["stage2_records"] == out["screen-stage1"]["include"]
    assert out["prepare-stage3"]["stage3_candidates"] == out["prepare-stage3"]["pmc_open_fulltexts"] + out["prepare-stage3"]["manual_retrieval_required"]
    assert out["reliability-report"] == {"stage1": "not_ready", "stage2": "not_ready", "stage3": "not_ready"}
    assert out["semantic-loading"] == {"method": "tfidf", "semantic_records": out["screen-stage1"]["include"]}
    assert out["build-assets"]["included_records"] == out["screen-stage1"]["include"]
    assert {r["status"] for r in w.read("alignment").collect()} == {"aligned"}
    assert w.read("stage1_double_screen").columns[-1] == "adjudication_notes"
    assert abs(sum(r["percent"] for r in w.read("review_type_counts").collect()) - 100) < 0.5


def test_command_line(spark, tmp_path, capsys):
    workspace(spark, tmp_path)
    got = cli.main(["--workspace", str(tmp_path), "dedupe"])
    assert json.loads(capsys.readouterr().out) == json.loads(json.dumps(got)) and got["combined_records"] == 25
    assert cli.main(["--workspace", str(tmp_path), "search-wos", "--query-key", "k"], {"search-wos": lambda w, k: {"key": k}}) == {"status": "ok", "key": "k"}
    assert cli.main(["--workspace", "x", "check-api-access"], {"probes": {"a": lambda: 1}}) == {"a": "ok"}
    assert cli.main(["--workspace", str(tmp_path), "assist-stage2-llm"]) == {"status": "missing_credentials", "detail": "'enricher'"}
    for stage in ("prepare-screening", "screen-stage1"):
        cli.main(["--workspace", str(tmp_path), stage])
    got = cli.main(["--workspace", str(tmp_path), "--clients", "tests.test_pipeline_stages:own_clients", "assist-stage2-llm"])
    assert got["status"] == "ok" and got["stage2_llm_rows"] > 0 == got["failed"]


def test_streams(spark, tmp_path):
    schema = "doi string, title string, year int, seen timestamp, n int"

    def add(name, rows):
        spark.createDataFrame(rows, "doi string, title string, year int, seen string, n int").withColumn("seen", F.to_timestamp("seen")).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    source = ingest.arriving(spark, f"{tmp_path}/in/*", schema)
    add("1", [("10.1/a", "A", 2020, "2026-01-01 00:00:00", 1), ("10.1/b", "B", 2020, "2026-01-01 00:01:00", 1)])
    ingest.run_upserts(source, f"{tmp_path}/out", ["doi"], "n", f"{tmp_path}/cp").awaitTermination()
    add("2", [("10.1/a", "A again", 2020, "2026-01-02 00:00:00", 2)])
    ingest.run_upserts(source, f"{tmp_path}/out", ["doi"], "n", f"{tmp_path}/cp").awaitTermination()
    assert {r["doi"]: r["title"] for r in ingest.current(spark, f"{tmp_path}/out", ["doi"], "n").collect()} == {"10.1/a": "A again", "10.1/b": "B"}
    # Another stream adds to the table; what is older than what is there doesn't count.
    ingest.run_upserts(source, f"{tmp_path}/out", ["doi"], "n", f"{tmp_path}/cp2").awaitTermination()
    before = sorted(ingest.current(spark, f"{tmp_path}/out", ["doi"], "n").collect())
    ingest.compact(spark, f"{tmp_path}/out", ["doi"], "n")
    assert len(ingest._folders(spark, f"{tmp_path}/out")) == 1
    assert sorted(ingest.current(spark, f"{tmp_path}/out", ["doi"], "n").collect()) == before and len(before) == 2
    for name, df, mode in (("firsts", ingest.first_seen(source, time="seen"), "append"), ("counts", ingest.windowed_counts(source, time="seen", key="doi"), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("firsts").count() == 2 and spark.table("counts").agg(F.sum("n")).first()[0] == 3
