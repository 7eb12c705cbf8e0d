"""Inputs that the catalogue's queries derive from the tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..storage import spread

#: Lines that are appended to every document, so that every rule of the floor has something to do.
NOISE_LINES = [
    "",
    "~~~~~~~~",
    "heartbeat of relay 4: alive",
    "\t \t",
    "64 bytes from 10.20.30.40: icmp_seq=88 ttl=57 time=11.9 ms",
    "WARN cabinet 14 sent no heartbeat since 03:12",
    "++++++++++++",
    "pong",
    "WARN cabinet 14 sent no heartbeat since 03:12",
    "relay 4 is unreachable, its last heartbeat was ok",
]

#: Lines for the salience queries: (text, whether it is noise).
SALIENCE_LINES = [
    ("ping reply: 32 bytes from 10.20.30.40, ttl=57", True),
    ("heartbeat of pump-3 load=0.41 seq=90210", True),
    ("=" * 64, True),
    ("GET /health HTTP/1.1 200", True),
    ("** ** ** ** ** **", True),
    ("tick tick tick tick tick tick tick tick tick", True),
    ("   ", True),
    ("FATAL: journal on vault3 refused 1,204 writes since 02:17, replica lag is now 340 s", False),
    ("Auditors may read the retention policy of the archive, but only two board members together can change it: chair and treasurer.", False),
    ("Kiln B7 held temperature=1180C at 16:40 and sank to 1094C by 17:05, below its limit", False),
]
TASK = "watch retention policy and disk temperature alerts"


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_values(rows: list[tuple]) -> str:
    def one(v) -> str:
        return sql_text(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else "NULL" if v is None else str(v)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _null(kind) -> F.Column:
    return F.lit(None).cast(kind)


def request(kind: str, ingest_id, source, session, text, task: str = "", fmt=None) -> list:
    """The columns of a request that holds one text."""
    values = {"ingest_id": ingest_id.cast("string"), "type": F.lit(kind), "source": source, "session": session, "task": F.lit(task), "format": fmt, "text": text}
    return [(values[f.name] if values.get(f.name) is not None else _null(f.dataType)).alias(f.name) for f in schema.REQUEST.fields]


def noisy_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as log requests, each followed by the noise lines."""
    text = F.concat(F.col("text"), F.lit("\n" + "\n".join(NOISE_LINES)))
    return spread(table(spark, sf_dir, "documents")).select(*request("log", F.col("doc_id"), F.col("source"), F.col("lang"), text))


NOISY_SQL = f"(SELECT doc_id, source, lang, text || chr(10) || array_to_string([{', '.join(map(sql_text, NOISE_LINES))}], chr(10)) AS text FROM documents)"


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten events a request, each a header line and, for some, indented lines; a blank line after every seventh event."""
    e = table(spark, sf_dir, "events")
    detail = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("\n  user "), F.col("user_id").cast("string"), F.lit("\n\tprops "), F.col("props"))).otherwise("")
    line = F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type"), detail, F.when(F.col("event_id") % 7 == 0, "\n").otherwise(""))
    grouped = e.groupBy(F.floor(F.col("event_id") / 10).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("line")))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return grouped.select(*request("log", F.col("batch"), F.lit("events"), F.lit("s"), text))


EVENT_SQL = """(SELECT event_id // 10 AS batch, string_agg('event ' || event_id || ' ' || event_type ||
  CASE WHEN event_id % 3 = 0 THEN chr(10) || '  user ' || user_id || chr(10) || chr(9) || 'props ' || props ELSE '' END ||
  CASE WHEN event_id % 7 = 0 THEN chr(10) ELSE '' END, chr(10) ORDER BY event_id) AS text FROM events GROUP BY 1)"""


def dialogues(spark: SparkSession, sf_dir: str, repeat: bool = False) -> DataFrame:
    """Conversations as dialogue requests. repeat: followed by a question that is asked and answered twice, and again by
    another speaker, with a blank turn between."""
    c = table(spark, sf_dir, "conversations")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    grouped = c.groupBy("conv_id").agg(turns.alias("rows"))
    turn = lambda s, t: F.struct(s.alias("speaker"), t.alias("text"), F.lit(None).cast("string").alias("turn_id"), F.lit(None).cast("timestamp").alias("ts"))
    found = F.transform("rows", lambda r: turn(r["role"], r["text"]))
    if repeat:
        found = F.concat(found, F.array(*[turn(F.lit(s), F.lit(t)) for s, t in REPEATED_TURNS]))
    columns = request("dialogue", F.col("conv_id"), F.lit("chat"), F.lit("s"), _null("string"))
    return grouped.select(*[c for c in columns[:-1]], found.cast(T.ArrayType(schema.TURN)).alias("turns"))


REPEATED_TURNS = [("a", "Are you sure?"), ("u", "yes"), ("a", "Are you sure?"), ("u", "yes"), ("a", "  "), ("b", "yes"), ("u", "yes"), ("a", "Shall I restart?"), ("u", "yes")]
REPEATED_SQL = f"""(SELECT conv_id, turn, role AS speaker, text FROM conversations UNION ALL
  SELECT conv_id, 1000 + n, speaker, text FROM (SELECT DISTINCT conv_id FROM conversations), (VALUES {sql_values([(k, *t) for k, t in enumerate(REPEATED_TURNS)])}) AS r(n, speaker, text))"""


def salience_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, data, is_noise: every line of every document (as signal), and the lines above. seq tells rows apart."""
    d = spread(table(spark, sf_dir, "documents")).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "data"))
    rows = d.select((F.col("doc_id") * 1000000 + F.col("pos")).alias("seq"), "data", F.lit(False).alias("is_noise"))
    extra = spark.createDataFrame([(-1 - k, t, n) for k, (t, n) in enumerate(SALIENCE_LINES)], "seq long, data string, is_noise boolean")
    return rows.unionByName(extra)


SALIENCE_SQL = f"""(SELECT doc_id * 1000000 + i - 1 AS seq, l[i] AS data, false AS is_noise
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  UNION ALL SELECT * FROM (VALUES {sql_values([(-1 - k, t, n) for k, (t, n) in enumerate(SALIENCE_LINES)])}) AS v(seq, data, is_noise))"""
