"""The stream's side output: valid rows and rejects, repeated batches, and typed rows."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tidemark.schemas import OHLCV, TRADES
from tidemark.sources import readers
from tidemark.streaming import ingest as ing
from tidemark.streaming import operators as st

GOOD = '{"symbol":"A","price":1.5,"quantity":2,"timestamp":"2024-01-01T00:00:01.000002","trade_id":7,"is_buyer_maker":true,"venue":"x"}'
BAD = {
    "{": ["malformed"],
    "": ["malformed"],
    "  ": ["malformed"],
    "5": ["malformed"],
    '{"symbol":"A","price":"dear","quantity":2,"timestamp":"2024-01-01T00:00:01"}': ["price: type"],
    '{"price":1,"quantity":{"a":1},"timestamp":"noon"}': ["symbol: missing", "quantity: type", "timestamp: type"],
    '{"symbol":"A","price":null,"quantity":2,"timestamp":"2024-01-01T00:00:01","trade_id":"x"}': ["price: missing", "trade_id: type"],
    "{}": ["symbol: missing", "price: missing", "quantity: missing", "timestamp: missing"],
}


def messages(spark, folder, *texts):
    spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema("value string").parquet(folder)


def test_messages_are_valid_or_rejected_with_reasons(spark):
    df = spark.createDataFrame([(t,) for t in [GOOD, None, *BAD]], "value string")
    ok, bad = readers.sort_out(df, TRADES)
    row = ok.first()
    assert ok.count() == 1 and ok.dtypes == list(TRADES.types.items())
    assert (row.symbol, row.price, row.quantity, row.timestamp, row.trade_id, row.is_buyer_maker) == ("A", 1.5, 2.0, dt.datetime(2024, 1, 1, 0, 0, 1, 2), 7, True)
    found = [(r.value, r.reasons) for r in bad.collect()]
    assert sorted(found) == sorted([("", ["malformed"]), *BAD.items()])


def test_two_batches_and_a_repeated_one(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    ing.ingest(messages(spark, source, GOOD, "{"), folder, TRADES)
    ing.ingest(messages(spark, source, GOOD.replace("7", "8"), "no json"), folder, TRADES)
    tables = lambda: (sorted(r.trade_id for r in ing.ingested(spark, folder, TRADES).collect()), sorted((r.batch, r.value) for r in ing.rejected(spark, folder).collect()))
    want = ([7, 8], [(0, "{"), (1, "no json")])
    assert tables() == want
    files = sorted(os.listdir(tmp_path / "out/raw_trades/batch=1"))
    os.remove(tmp_path / "out/checkpoint-raw_trades/commits/1")  # as if the run had died before the batch was committed
    crc = tmp_path / "out/checkpoint-raw_trades/commits/.1.crc"
    crc.unlink(missing_ok=True)
    ing.ingest(messages(spark, source), folder, TRADES)
    assert tables() == want and sorted(os.listdir(tmp_path / "out/raw_trades/batch=1")) == files


def test_a_batch_of_which_only_the_rejects_were_written(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    ing.ingest(messages(spark, source, GOOD, "{"), folder, TRADES)
    os.rename(tmp_path / "out/raw_trades/batch=0", tmp_path / "out/raw_trades/_staging-0")
    for name in ("0", ".0.crc"):
        (tmp_path / "out/checkpoint-raw_trades/commits" / name).unlink(missing_ok=True)
    ing.ingest(messages(spark, source), folder, TRADES)
    assert ing.ingested(spark, folder, TRADES).count() == 1 and ing.rejected(spark, folder).count() == 1


def test_no_input_gives_empty_tables(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([], "value string").write.parquet(source)
    ing.ingest(spark.readStream.schema("value string").parquet(source), str(tmp_path / "out"), TRADES)
    assert ing.ingested(spark, str(tmp_path / "out"), TRADES).isEmpty() and ing.rejected(spark, str(tmp_path / "out")).isEmpty()


def test_typed_rows_of_another_table(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("A", "1h", 1.0, 2.0, 0.5, 1.5, 3.0, start), ("A", "1h", 1.0, 2.0, 0.5, None, 3.0, start)]
    df = spark.createDataFrame(rows, "symbol string, interval string, open double, high double, low double, close double, volume double, timestamp timestamp")
    ok, bad = ing.valid_and_rejects(df.withColumn("extra", F.lit(1)), OHLCV)
    assert ok.columns == list(OHLCV.types) and ok.count() == 1
    assert bad.first().reasons == ["close: missing"] and '"extra":1' in bad.first().value


def test_pipeline_from_messages_keeps_what_it_rejects(spark, tmp_path):
    texts = ['{"symbol":"A","price":%d,"quantity":1,"timestamp":"2024-01-01T%02d:30:00","trade_id":%d}' % (10 + i, i, i) for i in range(24)]
    texts += ["{", '{"symbol":"A","price":1,"quantity":1,"trade_id":99}', texts[3]]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for _ in range(2):
        st.run_pipeline(messages(spark, str(tmp_path / "in"), *texts), str(tmp_path / "out"))
        texts = []
    bars = {r.timestamp.hour: (r.open, r.volume) for r in spark.read.parquet(str(tmp_path / "out/ohlcv")).collect()}
    assert bars == {i: (10.0 + i, 1.0) for i in range(23)}  # the last window is open
    assert sorted(r.reasons[0] for r in ing.rejected(spark, str(tmp_path / "out")).collect()) == ["malformed", "timestamp: missing"]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
