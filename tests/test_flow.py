"""Model, streaming, sinks and the whole way through."""

import uuid

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import corpus, labelling, model
from ledgerloom.plans import inputs
from ledgerloom.plans.rendered import tables
from ledgerloom.plans.rendered_headers import header_pages
from ledgerloom.plans.statements import output_name, process, report_sheets, run_batch
from ledgerloom.session import shared_folder
from ledgerloom.sources import reports, statements
from ledgerloom.streaming.ingest import ingest_stream


@pytest.fixture(scope="module")
def trained(spark):
    return model.train(spark=spark)


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "description string")


def test_model_knows_its_categories(spark, trained):
    fitted, report = trained
    got = {r.description: r for r in fitted.score(texts(spark, "SWIGGY FOOD ORDER DELIVERY", "MONTHLY SALARY PAYROLL")).collect()}
    assert got["SWIGGY FOOD ORDER DELIVERY"].ml_category == "Food & Dining"
    assert got["SWIGGY FOOD ORDER DELIVERY"].ml_confidence >= 0.40
    assert got["MONTHLY SALARY PAYROLL"].ml_category == "Salary & Income"
    assert fitted.accuracy > 0.8 and report.count() == len(corpus.SEEDS)


def test_saved_model_scores_the_same(spark, trained):
    fitted, _ = trained
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    fitted.save(path)
    again = model.load_model(spark, path)
    rows = texts(spark, "petrol pump", "atm cash", "zzz")
    assert fitted.score(rows).collect() == again.score(rows).collect()
    assert again.accuracy == fitted.accuracy
    facts = model.model_info(spark, path).first()
    n = corpus.augment(corpus.seed_corpus(spark)).count()
    assert facts.total_samples == n == again.train_samples + again.test_samples
    assert 0.19 < facts.test_samples / n < 0.21 and facts.train_samples == fitted.train_samples


def test_gradient_is_flat_at_the_fit_only(spark):
    rows = [(i, c, f"{w} {x}") for i, (c, w, x) in enumerate(
        [("a", "red", "one"), ("a", "red", "two"), ("b", "blue", "two"), ("c", "green", "one"), ("c", "green", "blue"), ("a", "x", "y")] * 3
    )] + [(99, "b", "?")]
    train = spark.createDataFrame(rows, "key long, category string, description string")
    fitted = model.fit(train)
    slopes = model.gradient(fitted, train, "key").collect()
    assert len(slopes) == 3 * (len(fitted.counter.vocabulary) + 1)
    assert max(abs(r.gradient) for r in slopes) < 1e-5
    # the same coefficients on other rows are not the best
    other = train.where("key <> 0")
    assert max(abs(r.gradient) for r in model.gradient(fitted, other, "key").collect()) > 1e-3


def test_hybrid_and_modes(spark, trained):
    fitted, _ = trained
    rows = spark.createDataFrame(
        [("POS 4 SHELL PETROL PUMP", 10, 0, "DEBIT"), ("rtgs vendor settlement", 10, 0, "DEBIT")],
        "description string, debit int, credit int, type string",
    )
    got = labelling.classify(rows, labelling.HYBRID, fitted).collect()
    assert (got[0].category, got[0].classification_method) == ("Travel & Fuel", "Heuristic Rule-Based")
    assert got[1].classification_method == "Traditional ML Model"
    with pytest.raises(ValueError):
        labelling.classify(rows, labelling.ML)


def test_stream_takes_each_file_once(spark, small):
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = inputs.entries(spark, small)
    first, second = rows.where("txn_id % 2 = 0"), rows.where("txn_id % 2 = 1")

    def drain():
        ingest_stream(
            spark, f"{base}/in", f"{base}/out", f"{base}/log", schema=rows.schema,
            process=labelling.label_by_rules, suffix=".parquet",
        ).awaitTermination()
        return spark.read.parquet(f"{base}/out")

    first.write.parquet(f"{base}/in")
    assert drain().count() == first.count()
    assert drain().count() == first.count()
    second.write.mode("append").parquet(f"{base}/in")
    out = drain()
    assert out.count() == rows.count() == out.select("txn_id").distinct().count()


def test_nested_parts(spark):
    rows = spark.createDataFrame([("a", i, i * 10) for i in range(1, 8)] + [("b", 1, 5)], "statement_id string, row_no long, v int")
    ids = spark.createDataFrame([("a", 7), ("b", 1), ("c", 0)], "statement_id string, n int")
    got = {(r.statement_id, r.part): r.transactions for r in reports.nested_result(rows, ids, part_rows=3).collect()}
    assert [len(got[("a", p)]) for p in (0, 1, 2)] == [3, 3, 1]
    assert [t.v for t in got[("a", 1)]] == [40, 50, 60]
    assert got[("c", None)] is None


def test_nested_anomalies(spark):
    rows = spark.createDataFrame([("a", i, i) for i in range(1, 6)], "statement_id string, row_no long, v int")
    ids = spark.createDataFrame([("a", 5), ("locked", 0), ("none", 0)], "statement_id string, n int")
    notes = spark.createDataFrame(
        [("a", 5, "five"), ("a", 2, "two"), ("a", 1, "one"), ("locked", None, "no way in")], "statement_id string, row_no long, anomaly string"
    )
    nested = reports.nested_result(rows, ids, notes, part_rows=3).collect()
    assert {(r.statement_id, r.part): r.anomalies for r in nested} == {
        ("a", 0): ["one", "two"], ("a", 1): ["five"], ("locked", 0): ["no way in"], ("none", None): [],
    }
    assert sum(len(r.transactions or []) for r in nested) == 5


def test_malformed_json_fails(spark):
    bad = spark.createDataFrame([('{"statement_id": "x"',)], "json string")
    with pytest.raises(Exception):
        reports.ledger_from_json(bad).collect()


def test_text_files_are_statements(spark):
    folder = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    spark.createDataFrame([("one\ftwo",)], "value string").coalesce(1).write.text(folder)
    got = statements.read_text_statements(spark, folder, pathGlobFilter="*.txt")
    assert [(r.page_no, r.text.strip()) for r in got.orderBy("page_no").collect()] == [(1, "one"), (2, "two")]


def test_outputs_are_named_after_the_input():
    named = {"s3a://box/may.2024.pdf": "may.2024", "/data/in/": "in", "in": "in", "/x/.hidden": ".hidden", "file:/a/b.c/d": "d"}
    assert {path: output_name(path) for path in named} == {path: f"{base}_classified" for path, base in named.items()}


def test_batch_run_writes_reports(spark, small):
    base = f"{shared_folder(spark)}/batch-{uuid.uuid4().hex}"
    as_text = F.col("statement_id").cast("string")
    header_pages(spark, small).withColumn("statement_id", as_text).write.parquet(f"{base}/in/pages")
    layout = F.when(F.col("statement_id") % 2 == 0, F.lit(0)).otherwise(F.lit(2))
    tables(spark, small, layout).withColumn("statement_id", as_text).write.parquet(f"{base}/in/tables")
    result = run_batch(spark, f"{base}/in", f"{base}/out", mode="heuristic", default_year=2024)
    n = inputs.entries(spark, small).count()
    assert result["ledger"].count() == n
    back = spark.read.option("header", True).csv(f"{base}/out/in_classified.csv")
    assert back.count() == n
    assert {"Date", "Description", "Debit", "Credit", "Balance", "Category"} <= set(back.columns)
    sheets = report_sheets(result)
    assert list(sheets) == ["account_overview", "classified_transactions", "category_breakdown", "monthly_trends"]
    overview = spark.read.parquet(f"{base}/out/in_classified/account_overview")
    assert overview.count() == 14 * result["statements"].count()
    nested = spark.read.json(f"{base}/out/in_classified.json")
    assert nested.where("transactions is not null").select(F.sum(F.size("transactions"))).first()[0] == n
    noted = nested.select(F.explode("anomalies").alias("anomaly"))
    assert noted.count() == result["anomalies"].count() > 0


def test_locked_documents_leave_the_flow(spark, small):
    pages = header_pages(spark, small).withColumn("statement_id", F.col("statement_id").cast("string"))
    locked = spark.createDataFrame([("0",), ("1",)], "statement_id string")
    result = process(pages, locked=locked, mode=labelling.HEURISTIC, default_year=2024)
    rows = {r.statement_id: r for r in result["statements"].where("statement_id IN ('0', '1')").collect()}
    assert {r.file_type for r in rows.values()} == {"Password-Protected PDF"}
    assert all(r.balance_mismatches_count == 1 and r.total_transactions == 0 for r in rows.values())


def test_split_is_the_same_in_any_number_of_blocks(spark, monkeypatch):
    rows = spark.range(400).selectExpr("id AS key", "IF(id % 3 = 0, 'hot', CAST(id % 7 AS string)) AS category")
    want = {(r.key, r.is_test) for r in corpus.stratified_split(rows, "category", "key").collect()}
    assert [corpus.hash_digits(n) for n in (0, 800_000, 800_001, 10**12)] == [1, 1, 2, 7]
    monkeypatch.setattr(corpus, "BLOCK_ROWS", 2)
    assert corpus.hash_digits(400) == 2
    assert {(r.key, r.is_test) for r in corpus.stratified_split(rows, "category", "key").collect()} == want
    assert corpus.stratified_split(rows.limit(0), "category", "key").count() == 0
