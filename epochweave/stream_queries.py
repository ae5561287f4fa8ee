"""Queries over running streams of events, and SQL with generators of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochweave.feeds.events import sessions, take_in, timed, without_repeats
from epochweave.functions.tables import register
from epochweave.places import shared_folder
from epochweave.registry import query, table

#: The events in four parts by time. Each part comes by itself; some events of the first half come with the last part, after the watermark.
_PARTS = "e as (select *, cast(floor((epoch_us(ts) - min(epoch_us(ts)) over ()) * 4.0 / (max(epoch_us(ts)) over () - min(epoch_us(ts)) over () + 1)) as bigint) as part from events), kept as (select * from e where not (event_id % 97 = 1 and part <= 1))"


def _streamed(spark, sf_dir, run) -> DataFrame:
    """run(stream, base) over what has come so far, again after each delivery: four parts of the events, every tenth event once more with the next part, then one event a year later, which lets all that is open end."""
    base, events = shared_folder(spark, "events"), table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = events.select(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    part = F.floor((F.unix_micros("ts") - low) * 4.0 / (high - low + 1))
    came = F.when((F.col("event_id") % 97 == 1) & (part <= 1), 3).otherwise(part)
    every = events.select("*", came.cast("int").alias("_came"))
    every = every.unionAll(every.where("event_id % 10 = 0").withColumn("_came", F.least(F.col("_came") + 1, F.lit(3))))
    last = events.limit(1).select(*[F.timestamp_micros(F.lit(high + 366 * 86_400_000_000)).alias("ts") if c == "ts" else F.lit(-1).cast("long").alias(c) if c in ("event_id", "user_id") else F.col(c) for c in events.columns])
    for k in range(5):
        (every.where(F.col("_came") == k).drop("_came") if k < 4 else last).write.mode("append").parquet(f"{base}/in")
        out = run(spark.readStream.schema(events.schema).parquet(f"{base}/in"), base)
    return out


@query("ext_running_without_repeats", f"with {_PARTS} select event_id, user_id, event_type from kept")
def running_without_repeats(spark, sf_dir):
    """Events that come twice count once, those later than the watermark not at all."""
    run = lambda stream, base: take_in(without_repeats(stream, "1 hour").select("event_id", "user_id", "event_type"), f"{base}/out", f"{base}/check")
    return _streamed(spark, sf_dir, run).where("event_id >= 0")


@query(
    "ext_running_sessions",
    f"with {_PARTS}, b as (select *, case when ts - lag(ts) over w <= interval 6 hour then 0 else 1 end as opens from kept window w as (partition by user_id order by ts, event_id)), "
    "s as (select *, sum(opens) over (partition by user_id order by ts, event_id) as number from b) select user_id, min(event_id) as first_event, max(event_id) as last_event, count(*) as n from s group by user_id, number",
)
def running_sessions(spark, sf_dir):
    """Two steps with state, one after the other: repeats go, then sessions are formed, and given out as the watermark passes them."""

    def run(stream, base):
        once = without_repeats(timed(stream, "1 hour"), None)
        found = sessions(once, None, "6 hours", F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))
        return take_in(found.select("user_id", "first_event", "last_event", "n"), f"{base}/out", f"{base}/check")

    return _streamed(spark, sf_dir, run).where("user_id >= 0")


_DOCUMENTS = (
    "with l as (select page_id, unnest(string_split(html, '>')) as line, generate_subscripts(string_split(html, '>'), 1) as i from pages), p as (select *, sum(case when trim(line) = '' then 1 else 0 end) over (partition by page_id order by i) as part from l) "
    "select page_id, cast(part as integer) as part, cast(count(*) as integer) as n_lines, md5(string_agg(line, chr(10) order by i)) as text_md5 from p where trim(line) <> '' group by all"
)


@query("q1_documents_by_partition", _DOCUMENTS)
def q1_partition(spark, sf_dir):
    register(spark)
    lines = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("html", ">")).alias("i", "line"))
    return spark.sql("select id as page_id, part, n_lines, md5(text) as text_md5 from documents_of_lines(table(select page_id, i, line from {lines}) partition by page_id order by i)", lines=lines)


@query("q1_documents_by_lateral_call", _DOCUMENTS)
def q1_lateral(spark, sf_dir):
    register(spark)
    return spark.sql("select p.page_id, d.part, d.n_lines, md5(d.text) as text_md5 from {pages} p, lateral documents_of_text(p.html, '>') d", pages=table(spark, sf_dir, "pages").select("page_id", "html"))


@query("q1_segment_chunks")
def q1_chunks(spark, sf_dir):
    """Cuts are drawn by chance; tests hold them to what a plain run over the same sentences gives."""
    from epochweave.text_queries import _sentences

    register(spark)
    return spark.sql("select * from segment_chunks(table(select doc_id, sentences from {docs}) partition by (doc_id), 125, 7)", docs=_sentences(spark, sf_dir))
