"""Streams over the event table, run to the end of what is there."""

import uuid
from datetime import date

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from checks.registry import check
from checks.standins import SCHEMAS, duck, load, table
from fjordbook.schema import ORG
from fjordbook.session import checkpoint_root
from fjordbook.sources.tables import TableStore
from fjordbook.streaming import changes as S
from fjordbook.streaming import clients as client_stream
from fjordbook.streaming.feed import ChangeFeed


def _folder(spark):
    return f"{checkpoint_root(spark)}/strom-{uuid.uuid4().hex}"


def _events(spark, sf_dir):
    return spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _feed(spark, sf_dir):
    kind = F.col("event_type")
    change = F.when(kind == "error", "Sletting").when(kind == "signup", "Ny").when(kind == "purchase", "Fjernet").otherwise("Endring")
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("oppdateringsid"), F.col("ts").alias("dato"),
        F.lpad(F.col("user_id").cast("string"), 9, "0").alias(ORG), change.alias("endringstype"))


def _documents(spark, sf_dir):
    """A document for every company that is not bankrupt."""
    companies = table(spark, sf_dir, "enheter").filter("not konkurs")
    body = F.to_json(F.struct(ORG, F.concat("navn", F.lit(" ny")).alias("navn")))
    return companies.select(ORG, body.alias("doc"))


_LAST = """sist AS (SELECT organisasjonsnummer, max(oppdateringsid) AS oppdateringsid, arg_max(endringstype, oppdateringsid) AS endringstype FROM feed GROUP BY 1),
logg AS (SELECT s.*, endringstype IN ('Sletting', 'Fjernet') AS slettes, coalesce(NOT e.konkurs, false) AS har_dok
         FROM sist s LEFT JOIN enheter e USING (organisasjonsnummer))"""


def _run(spark, sf_dir):
    out = _folder(spark)
    query = S.start_change_stream(_feed(spark, sf_dir), lambda: _documents(spark, sf_dir), f"{out}/logg", f"{out}/sjekk")
    query.awaitTermination()
    return f"{out}/logg"


@check("stream_changes", tables="feed enheter", ctes=_LAST, oracle="""
SELECT organisasjonsnummer, oppdateringsid, endringstype, slettes, NOT slettes AS har_dok FROM logg WHERE slettes OR har_dok""")
def stream_changes(spark, sf_dir):
    rows = S.logged_changes(spark, _run(spark, sf_dir))
    return rows.select(ORG, "oppdateringsid", "endringstype", "slettes", F.col("doc").isNotNull().alias("har_dok"))


@check("stream_dead_letters", tables="feed enheter", ctes=_LAST, oracle="""
SELECT organisasjonsnummer, oppdateringsid, endringstype FROM logg WHERE NOT slettes AND NOT har_dok""")
def stream_dead_letters(spark, sf_dir):
    return S.waiting(spark, _run(spark, sf_dir))


@check("stream_cursor", tables="feed", oracle="""
SELECT oppdateringsid AS siste_id, epoch_us(dato) AS siste_tid FROM feed WHERE oppdateringsid >= ALL (SELECT oppdateringsid FROM feed)""")
def stream_cursor(spark, sf_dir):
    return S.cursor(spark, _run(spark, sf_dir)).withColumn("siste_tid", F.unix_micros("siste_tid"))


@check("stream_late_document", tables="feed enheter", ctes=_LAST, oracle="""
SELECT organisasjonsnummer, 1 AS steder FROM logg WHERE NOT slettes""")
def stream_late_document(spark, sf_dir):
    """Documents that come and go while a batch is written: every changed company is in the log or waits, never neither."""
    out = f"{_folder(spark)}/logg"
    coming = _documents(spark, sf_dir).filter(F.rand() < 0.5)
    feed = table(spark, sf_dir, "feed").withColumn("dato", F.col("dato").cast("timestamp"))
    S.write_batch(feed, 0, coming, out)
    logged = S.logged_changes(spark, out).filter("not slettes").select(ORG)
    return logged.unionAll(S.waiting(spark, out).select(ORG)).groupBy(ORG).agg(F.count(F.lit(1)).alias("steder"))


class _Busy(TableStore):
    """A store that a batch lands beside, after its tables are written and before anything else is done."""

    landing = None

    def publish_together(self, frames, properties=None):
        stored = super().publish_together(frames, properties)
        if self.landing:
            self.landing()
            self.landing = None
        return stored


def _applied(number, before, condition):
    """SQL of the companies after the last changes of some events, over the companies ``before`` them."""
    return f"""siste{number} AS (
  SELECT organisasjonsnummer, arg_max(endringstype, oppdateringsid) IN ('Sletting', 'Fjernet') AS slettes FROM feed
  WHERE oppdateringsid {condition} (SELECT floor(avg(oppdateringsid)) FROM feed) GROUP BY 1),
etter{number} AS (
  SELECT e.organisasjonsnummer, CASE WHEN NOT s.slettes AND NOT o.konkurs THEN o.navn || ' ny' ELSE e.navn END AS navn,
         CASE WHEN s.slettes THEN coalesce(e.slettet_dato, DATE '2024-06-01') WHEN NOT o.konkurs AND s.slettes IS NOT NULL THEN NULL ELSE e.slettet_dato END AS slettet_dato
  FROM {before} e LEFT JOIN siste{number} s USING (organisasjonsnummer) JOIN enheter o USING (organisasjonsnummer))"""


@check("stream_compacted", tables="feed enheter", ctes=f"{_applied(1, 'enheter', '<=')},\n{_applied(2, 'etter1', '>')}", oracle="""
SELECT organisasjonsnummer, navn, cast(slettet_dato AS VARCHAR) AS slettet_dato, (SELECT max(oppdateringsid) FROM feed) AS siste_id, 2 AS epoke FROM etter2""")
def stream_compacted(spark, sf_dir):
    """The log is compacted while its second half lands, and again after that: no change is lost, the cursor stays."""
    root = _folder(spark)
    out, store, base, day = f"{root}/logg", _Busy(spark, f"{root}/lager"), table(spark, sf_dir, "enheter"), date(2024, 6, 1)
    feed = table(spark, sf_dir, "feed").withColumn("dato", F.col("dato").cast("timestamp"))
    half = feed.select(F.expr("floor(avg(oppdateringsid))")).scalar()
    S.write_batch(feed.filter(F.col("oppdateringsid") <= half), 0, _documents(spark, sf_dir), out)
    store.landing = lambda: S.write_batch(feed.filter(F.col("oppdateringsid") > half), 1, _documents(spark, sf_dir), out)
    S.compact(base, out, day, store)
    after = S.compact(store.read("enheter"), out, day, store)
    rows = S.current_companies(store.read("enheter"), out, day, S.epoch_of(store))
    reached = S.cursor(spark, out, after).select("siste_id").scalar()
    return rows.select(ORG, "navn", "slettet_dato", reached.alias("siste_id"), F.lit(S.epoch_of(store).number).alias("epoke"))


@check("stream_retry", tables="feed enheter", ctes=_LAST, oracle="""
SELECT organisasjonsnummer, CASE WHEN slettes OR har_dok THEN 'logg' ELSE 'venter' END AS sted,
       CASE WHEN slettes OR (har_dok AND organisasjonsnummer::BIGINT % 2 = 0) THEN 0 WHEN har_dok THEN 1 ELSE 1 END AS batch_id FROM logg""")
def stream_retry(spark, sf_dir):
    """Half of the documents come with the next batch: its dead letters are tried again, others wait on."""
    out = f"{_folder(spark)}/logg"
    feed = table(spark, sf_dir, "feed").withColumn("dato", F.col("dato").cast("timestamp"))
    documents = _documents(spark, sf_dir)
    S.write_batch(feed, 0, documents.filter(F.col(ORG).cast("long") % 2 == 0), out)
    S.write_batch(feed.limit(0), 1, documents, out)
    logged = spark.read.parquet(f"{out}/endringer").select(ORG, F.lit("logg").alias("sted"), F.col("batch_id").cast("int"))
    return logged.unionByName(S.waiting(spark, out).select(ORG, F.lit("venter").alias("sted"), F.lit(1).alias("batch_id")))


_BATCHES = """alle AS (SELECT count(DISTINCT organisasjonsnummer) AS n FROM feed),
bunker AS (
  SELECT 0 AS bunke, -1::BIGINT AS etter
  UNION ALL SELECT bunke + 1, max(forste) - 1 FROM (
    SELECT b.bunke, b.etter, f.organisasjonsnummer, min(f.oppdateringsid) AS forste FROM bunker b JOIN feed f ON f.oppdateringsid > b.etter GROUP BY ALL) t
  GROUP BY bunke, etter HAVING count(*) = (SELECT n FROM alle))"""


@check("stream_capped_batches", oracle=f"""WITH RECURSIVE {duck('feed').removeprefix('WITH ')},
{_BATCHES}
SELECT oppdateringsid, organisasjonsnummer, cast((SELECT max(bunke) FROM bunker b WHERE b.etter < f.oppdateringsid) AS BIGINT) AS bunke FROM feed f""")
def stream_capped_batches(spark, sf_dir):
    """Batches of all companies but one; the third is interrupted after its rows are written, and done again."""
    out, feed = _folder(spark), table(spark, sf_dir, "feed")
    feed.select(F.col("oppdateringsid").cast("long"), F.col("dato").cast("timestamp"), ORG, "endringstype").repartitionByRange(3, "oppdateringsid").sortWithinPartitions("oppdateringsid").write.parquet(f"{out}/feed")
    most = feed.agg(F.countDistinct(ORG)).first()[0] - 1
    spark.dataSource.register(ChangeFeed)
    failures = [2]

    def batch(rows, number):
        rows.select("oppdateringsid", ORG).write.mode("overwrite").parquet(f"{out}/bunker/bunke={number}")
        if number in failures:
            failures.remove(number)
            raise RuntimeError("interrupted")

    for _ in range(2):
        source = spark.readStream.format("endringsstrom").option("path", f"{out}/feed").option("companies", most).option("page", 1000).load()
        query = source.writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}/sjekk").trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        except StreamingQueryException as error:
            if "interrupted" not in str(error):
                raise
        finally:
            query.stop()
    return spark.read.parquet(f"{out}/bunker").select("oppdateringsid", ORG, F.col("bunke").cast("long"))


def _requests(events):
    """The events as requests of ten clients, in a twenty-thousandth of their time."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select((F.col("user_id") % 10).alias("user_id"), "event_type", F.timestamp_micros(F.floor(micros / 20000)).alias("ts"))


_REQUESTS = """foresp AS (SELECT user_id % 10 AS user_id, event_type, epoch_us(ts) // 20000 AS t FROM events),
vinduer AS (
  SELECT user_id, event_type, min(t) AS s FROM foresp GROUP BY 1, 2
  UNION ALL SELECT v.user_id, v.event_type, min(f.t) FROM vinduer v JOIN foresp f ON f.user_id = v.user_id AND f.event_type = v.event_type AND f.t >= v.s + 60000000 GROUP BY v.user_id, v.event_type, v.s),
talt AS (
  SELECT v.user_id, v.event_type, v.s, count(*) AS antall, s + 60000000 > (SELECT max(t) // 1000 * 1000 - 10000000 FROM foresp) AS apen
  FROM vinduer v JOIN foresp f ON f.user_id = v.user_id AND f.event_type = v.event_type AND f.t >= v.s AND f.t < v.s + 60000000 GROUP BY ALL)"""
_WINDOWS = "SELECT user_id, event_type, s AS vindu, antall, greatest(antall - 60, 0) AS avvist, antall > 60 AS over_grensen{} FROM talt"


@check("client_windows", oracle=f"WITH RECURSIVE {_REQUESTS}\n{_WINDOWS.format('')}")
def client_windows(spark, sf_dir):
    """Sixty requests a minute, in windows from each client's own first request."""
    rows = client_stream.client_windows(_requests(load(spark, sf_dir, "events")))
    return rows.withColumn("vindu", F.unix_micros("vindu"))


@check("stream_client_windows", oracle=f"WITH RECURSIVE {_REQUESTS}\n{_WINDOWS.format(', apen')}")
def stream_client_windows(spark, sf_dir):
    """The same from a stream; windows that the watermark has not passed are marked open."""
    out = _folder(spark)
    client_stream.start_client_stream(_requests(_events(spark, sf_dir)), f"{out}/vinduer", f"{out}/sjekk").awaitTermination()
    return client_stream.streamed_windows(spark, f"{out}/vinduer").withColumn("vindu", F.unix_micros("vindu"))


@check("stream_rate_windows", oracle="""
SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS vindu, user_id, event_type, count(*) AS antall, greatest(count(*) - 1, 0) AS avvist, count(*) > 1 AS over_grensen
FROM events GROUP BY 1, 2, 3 HAVING date_trunc('hour', min(ts)) + INTERVAL 1 HOUR <= (SELECT max(date_trunc('milliseconds', ts)) FROM events) - INTERVAL 10 MINUTE""")
def stream_rate_windows(spark, sf_dir):
    """Windows that have closed; the last ones stay open until later events arrive."""
    out = _folder(spark)
    query = S.start_rate_stream(_events(spark, sf_dir), f"{out}/vinduer", f"{out}/sjekk", limit=1, width="1 hour", delay="10 minutes")
    query.awaitTermination()
    return spark.read.parquet(f"{out}/vinduer").withColumn("vindu", F.unix_timestamp("vindu"))
