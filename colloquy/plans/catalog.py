"""The named queries of the engine over the test tables, and the same in SQL for DuckDB.

The test tables stand for the store: conversations are segments (conv_id the project, turn the position, role the
speaker), events timed segments of users, documents notes, embeddings voiceprints, nations and customers folders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import text as tx
from ..operators import blocks, intervals, knowledge, ordered, relational, vectors
from ..sources.store import read_table

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: read_table(spark, sf_dir, name))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import live, meetings  # noqa: F401  register the rest

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def micros(column: str = "ts"):
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def segments(t) -> DataFrame:
    return t("conversations").select(F.col("conv_id").alias("project_id"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), "text")


def timed(t) -> DataFrame:
    """Events as timed segments: value (in tenths of a second) is the duration."""
    start = micros() / 1e6
    return t("events").select("user_id", "event_id", "event_type", (start).alias("start"), (start + F.col("value") / 10).alias("end"), "value")


TIMED = "(SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + value / 10 AS \"end\", value FROM events)"


def sql_any(column: str, phrases) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(column, p.replace("'", "''")) for p in phrases) + ")"


# --- scans, filters, projections, sorts ---------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def scan_projects(t):
    return t("orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey")


@query("SELECT conv_id AS project_id, turn AS idx, role AS speaker, text FROM conversations WHERE conv_id = 7")
def segments_of_project(t):
    return segments(t).filter(F.col("project_id") == 7).orderBy("idx")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id = 42")
def note_lookup(t):
    return t("documents").filter(F.col("doc_id") == 42).select("doc_id", "lang", "n_chars").limit(1)


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src2')")
def optional_in_filter(t):
    return relational.optional_in(t("documents"), "source", ["src1", "src2"]).select("doc_id", "source")


@query("SELECT doc_id FROM documents")
def optional_in_filter_empty(t):
    return relational.optional_in(t("documents"), "source", []).select("doc_id")


@query("""SELECT c.conv_id AS project_id, c.turn AS idx, c.role AS speaker, c.text, d.lang AS title, d.n_chars AS updated_at
    FROM conversations c JOIN documents d ON c.conv_id = d.doc_id WHERE contains(lower(c.text), 'the')
    ORDER BY d.n_chars DESC, c.conv_id, c.turn LIMIT 50""")  # fmt: skip
def search_segments(t):
    projects = t("documents").select(F.col("doc_id").alias("project_id"), F.col("lang").alias("title"), F.col("n_chars").alias("updated_at"))
    return relational.search_segments(segments(t), projects, " The ").select("project_id", "idx", "speaker", "text", "title", "updated_at")


@query("SELECT conv_id AS project_id, turn AS segment_index FROM conversations WHERE contains(lower(text), 'on') AND role IN ('user', 'assistant')")
def search_completed_jobs(t):
    hits = segments(t).filter(relational.contains_text(F.col("text"), "ON") & F.col("speaker").isin("user", "assistant"))
    return hits.select("project_id", F.col("idx").alias("segment_index"))


@query("SELECT count(*) AS n FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def prefix_count(t):
    return t("customer").filter(F.startswith("c_name", F.lit("Customer#00000001"))).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, left(text, 100) AS preview, left(text, 200) AS context FROM documents")
def previews(t):
    return t("documents").select("doc_id", F.substring("text", 1, 100).alias("preview"), F.substring("text", 1, 200).alias("context"))


@query("SELECT conv_id AS project_id, string_agg('[' || coalesce(role, 'Unknown') || '] ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def transcript_lines(t):
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", "speaker", "text"))), lambda s: tx.line(s["speaker"], s["text"]))
    return segments(t).groupBy("project_id").agg(F.array_join(lines, "\n").alias("transcript"))


@query("SELECT user_id, count(*) AS segment_count, CAST(round(max_by(value, event_id) * 1000) AS BIGINT) AS duration_ms FROM events GROUP BY user_id")
def segment_counts(t):
    return t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("segment_count"), F.round(F.max_by("value", "event_id") * 1000).cast("long").alias("duration_ms"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
def newest_first(t):
    return t("orders").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").select("o_orderkey", "o_totalprice").limit(20)


_MIME_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.MIME.items())


@query(f"SELECT event_id, CASE lower(string_split(name, '.')[-1]) {_MIME_CASES} ELSE 'application/octet-stream' END AS mime FROM (SELECT event_id, 'f.' || CASE event_id % 4 WHEN 0 THEN 'PDF' WHEN 1 THEN 'tar.md' WHEN 2 THEN 'xyz' ELSE 'mp3' END AS name FROM events)")
def mime_types(t):
    name = F.concat(F.lit("f."), F.when(F.col("event_id") % 4 == 0, "PDF").when(F.col("event_id") % 4 == 1, "tar.md").when(F.col("event_id") % 4 == 2, "xyz").otherwise("mp3"))
    return t("events").select("event_id", tx.mime_type(name).alias("mime"))


# --- joins and merges -----------------------------------------------------------------------------------------------


@query("SELECT d.doc_id AS project_id, coalesce(CAST(l.quality AS VARCHAR), 'Unknown') AS project_title FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def title_lookup(t):
    projects = t("labels").select(F.col("doc_id").alias("project_id"), F.col("quality").cast("string").alias("title"))
    return relational.with_title(t("documents").select(F.col("doc_id").alias("project_id")), projects)


@query("""SELECT e.user_id AS project_id, c.c_name AS project_title, CAST(json_extract(e.props, '$.k') AS BIGINT) AS k
    FROM events e JOIN customer c ON e.user_id = c.c_custkey""")  # fmt: skip
def action_items(t):
    lists = t("events").select(F.col("user_id").alias("project_id"), F.concat(F.lit("["), F.col("props"), F.lit("]")).alias("action_items"))
    projects = t("customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("title"))
    return relational.action_items(lists, projects, "array<struct<k:bigint>>")


FOLDERS = """SELECT 'r' || r_regionkey AS id, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer"""


def folders(t) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        t("region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
        .unionByName(t("nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent_id")))
        .unionByName(t("customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent_id")))
    )


@query(f"WITH RECURSIVE f AS ({FOLDERS}), tree(id, depth) AS (SELECT id, 0 FROM f WHERE id = 'r1' UNION ALL SELECT f.id, tree.depth + 1 FROM f JOIN tree ON f.parent_id = tree.id) SELECT id, depth FROM tree")
def folder_subtree(t):
    return relational.subtree(folders(t), "r1")


@query(f"""WITH RECURSIVE f AS ({FOLDERS}), up(id, anc, k) AS (SELECT id, id, 0 FROM f UNION ALL SELECT up.id, f.parent_id, k + 1 FROM up JOIN f ON up.anc = f.id WHERE f.parent_id IS NOT NULL),
    depth AS (SELECT id, max(k) AS d FROM up GROUP BY id), height AS (SELECT anc AS id, max(k) AS h FROM up GROUP BY anc),
    m AS (SELECT 'c' || c_custkey AS moved, 'n' || (c_custkey % 25) AS target FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || (n_nationkey % 5) FROM nation
      UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey % 7) FROM nation UNION ALL SELECT 'r' || r_regionkey, 'n' || n_nationkey FROM region, nation WHERE n_nationkey < 5)
    SELECT m.moved, m.target, m.target IS DISTINCT FROM f.parent_id AND m.moved <> m.target AND NOT EXISTS (SELECT 1 FROM up WHERE up.id = m.target AND up.anc = m.moved) AND d.d + 1 + h.h <= 2 AS allowed
      FROM m JOIN f ON f.id = m.moved JOIN depth d ON d.id = m.target JOIN height h ON h.id = m.moved""")  # fmt: skip
def allowed_moves(t):
    """Folders dragged onto others: two levels below a root are allowed, and none into itself."""
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    key, nation, region = F.col("c_custkey"), F.col("n_nationkey"), t("region").select("r_regionkey")
    moves = (
        t("customer").select(name("c", key).alias("moved"), name("n", key % 25).alias("target"))
        .unionByName(t("nation").select(name("n", nation).alias("moved"), name("r", nation % 5).alias("target")))
        .unionByName(t("nation").select(name("n", nation).alias("moved"), name("n", nation % 7).alias("target")))
        .unionByName(region.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(name("r", F.col("r_regionkey")).alias("moved"), name("n", F.col("k")).alias("target")))
    )
    return relational.allowed_moves(folders(t).withColumn("is_folder", F.lit(True)), moves)


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def cascade_delete(t):
    gone = t("nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("id"))
    return relational.without_ids(t("customer"), gone, "c_nationkey").select("c_custkey")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_summary(t):
    return relational.latest_wins(t("events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("""SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.v, o.v) AS v, coalesce(o.made, n.made) AS made
    FROM (SELECT doc_id, n_chars AS v, 'old' AS made FROM documents) o
    FULL OUTER JOIN (SELECT doc_id, CAST(quality AS BIGINT) AS v, 'new' AS made FROM labels) n ON o.doc_id = n.doc_id""")  # fmt: skip
def upsert_notes(t):
    old = t("documents").select("doc_id", F.col("n_chars").alias("v"), F.lit("old").alias("made"))
    new = t("labels").select("doc_id", F.col("quality").cast("long").alias("v"), F.lit("new").alias("made"))
    return relational.keyed_merge(old, new, ["doc_id"], keep=("made",))


@query("SELECT c_custkey, CASE WHEN c_custkey = 5 THEN 'renamed' ELSE c_name END AS c_name FROM customer")
def partial_update(t):
    return relational.partial_update(t("customer").select("c_custkey", "c_name"), "c_custkey", 5, {"c_name": "renamed"})


@query("SELECT n_nationkey, CAST(coalesce(o.pos, n_nationkey) AS BIGINT) AS sort_order FROM nation LEFT JOIN (VALUES (3, 0), (1, 1), (2, 2)) o(id, pos) ON n_nationkey = o.id")
def reorder(t):
    return relational.reordered(t("nation").select("n_nationkey", F.col("n_nationkey").cast("long").alias("sort_order")), "n_nationkey", "sort_order", [3, 1, 2])


@query("SELECT c.conv_id, c.turn, coalesce(n.n_name, c.role) AS speaker FROM conversations c LEFT JOIN nation n ON c.turn = n.n_nationkey")
def rename_speakers(t):
    names = t("nation").select(F.col("n_nationkey").cast("long").alias("turn"), "n_name")
    return t("conversations").join(names, "turn", "left").select("conv_id", "turn", F.coalesce("n_name", "role").alias("speaker"))


@query("""SELECT c_mktsegment AS name FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_custkey <= 2)
    UNION ALL SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment NOT IN (SELECT c_mktsegment FROM customer WHERE c_custkey <= 2)""")  # fmt: skip
def create_if_absent(t):
    names = t("customer").select(F.col("c_mktsegment").alias("name"), "c_custkey")
    return relational.created_if_absent(names.filter("c_custkey <= 2").select("name").distinct(), names.select("name"), "name")


@query("SELECT DISTINCT ON (k) k, src FROM (SELECT n_nationkey AS k, 'nation' AS src, 0 AS p FROM nation UNION ALL SELECT s_nationkey, 'supplier', 1 FROM supplier UNION ALL SELECT c_nationkey, 'customer', 2 FROM customer) ORDER BY k, p")
def merge_by_precedence(t):
    one = lambda name, col: t(name).select(F.col(col).alias("k"), F.lit(name).alias("src")).distinct()
    return relational.first_wins([one("nation", "n_nationkey"), one("supplier", "s_nationkey"), one("customer", "c_nationkey")], ["k"])


@query("SELECT doc_id, coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS v FROM (SELECT d.doc_id, d.source, l.quality AS v FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")
def propagate_voiceprints(t):
    rows = t("documents").select("doc_id", "source").join(t("labels").select("doc_id", F.col("quality").alias("v")), "doc_id", "left")
    return relational.fill_from_label(rows, "source", "v", ["doc_id"]).select("doc_id", "v")


_TURNS = f"(SELECT user_id, start, \"end\", event_type AS speaker, event_id AS pos FROM {TIMED} WHERE event_id % 3 = 0)"
_POINTS = f"(SELECT user_id, event_id AS idx, (start + \"end\") / 2 AS t FROM {TIMED} WHERE event_id % 3 <> 0)"


_NEAR = """SELECT user_id, idx, t, speaker, abs_far FROM (SELECT p.user_id, p.idx, p.t, u.speaker, least(abs(p.t - u.start), abs(p.t - u."end")) AS abs_far,
    row_number() OVER (PARTITION BY p.user_id, p.idx ORDER BY {order}) AS rn FROM {points} p JOIN {turns} u ON p.user_id = u.user_id AND {on}) WHERE rn = 1"""


def _sql_near(on: str, order: str) -> str:
    return "(" + _NEAR.format(points=_POINTS, turns=_TURNS, on=on, order=order) + ")"


_INSIDE = 'u.start <= p.t AND p.t <= u."end"'
_SPEAKERS = f"""(SELECT p.user_id, p.idx, CASE WHEN i.idx IS NOT NULL THEN i.speaker WHEN a.idx IS NULL OR b.abs_far <= a.abs_far THEN b.speaker ELSE a.speaker END AS speaker FROM {_POINTS} p
    LEFT JOIN {_sql_near(_INSIDE, 'u.start DESC, u.pos DESC')} i ON p.user_id = i.user_id AND p.idx = i.idx
    LEFT JOIN {_sql_near('u.start <= p.t', 'u.start DESC, u.pos DESC')} b ON p.user_id = b.user_id AND p.idx = b.idx
    LEFT JOIN {_sql_near('u.start > p.t', 'u.start, u.pos')} a ON p.user_id = a.user_id AND p.idx = a.idx)"""


def _turns_and_points(t) -> tuple[DataFrame, DataFrame]:
    rows = timed(t)
    turns = rows.filter("event_id % 3 = 0").select("user_id", "start", "end", F.col("event_type").alias("speaker"), F.col("event_id").alias("pos"))
    return turns, rows.filter("event_id % 3 <> 0").select("user_id", F.col("event_id").alias("idx"), ((F.col("start") + F.col("end")) / 2).alias("t"), "start", "end", F.col("event_type").alias("speaker"))


@query(f"SELECT user_id, idx, speaker FROM {_SPEAKERS}")
def assign_speakers(t):
    turns, points = _turns_and_points(t)
    return intervals.assign_turns(points.select("user_id", "idx", "t"), turns, ["user_id"]).select("user_id", "idx", "speaker")


@query(f"""SELECT p.user_id, p.idx, coalesce(i.speaker, n.speaker) AS speaker FROM {_POINTS} p
    LEFT JOIN {_sql_near(_INSIDE, 'u.pos')} i ON p.user_id = i.user_id AND p.idx = i.idx
    LEFT JOIN {_sql_near('true', 'least(abs(p.t - u.start), abs(p.t - u."end")), u.pos')} n ON p.user_id = n.user_id AND p.idx = n.idx""")  # fmt: skip
def assign_speakers_linear(t):
    turns, points = _turns_and_points(t)
    return intervals.assign_turns_linear(points.select("user_id", "idx", "t"), turns, ["user_id"]).select("user_id", "idx", "speaker")


@query(f"SELECT s.user_id, s.idx, coalesce(s.speaker, e.event_type) AS speaker FROM {_SPEAKERS} s JOIN events e ON s.idx = e.event_id")
def assign_or_keep(t):
    turns, points = _turns_and_points(t)
    return intervals.assign_speakers(points.drop("t"), turns, ["user_id"]).select("user_id", "idx", "speaker")


@query(f"SELECT user_id, arg_min(event_id, abs(start - 1704067200.0) * 1e6 + 0 * event_id) AS idx FROM (SELECT * FROM {TIMED} ORDER BY user_id, event_id) GROUP BY user_id")
def nearest_segment(t):
    return intervals.nearest_segment(timed(t).withColumnRenamed("event_id", "idx"), ["user_id"], 1704067200.0)


# --- aggregations ---------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS meetings, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS total_chars FROM documents")
def meeting_stats(t):
    return t("documents").agg(F.count(F.lit(1)).alias("meetings"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("total_chars"))


@query("SELECT CASE WHEN coalesce(role, '') = '' THEN 'Unknown' ELSE role END AS speaker, CAST(sum(length(text)) AS BIGINT) AS total_duration, count(*) AS segment_count FROM conversations GROUP BY role")
def speaker_analysis(t):
    return relational.speaker_analysis(segments(t), "speaker", F.length("text"))


@query("SELECT DISTINCT conv_id AS project_id FROM conversations")
def distinct_projects(t):
    return segments(t).select("project_id").distinct()


@query("SELECT c_nationkey AS parent, coalesce(max(c_custkey), -1) AS max_order FROM customer GROUP BY c_nationkey")
def sibling_max(t):
    return t("customer").groupBy(F.col("c_nationkey").alias("parent")).agg(F.coalesce(F.max("c_custkey"), F.lit(-1)).alias("max_order"))


@query("SELECT user_id, event_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f) AS rn FROM (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS f FROM events GROUP BY ALL)) WHERE rn = 1")
def majority_label(t):
    return relational.majority(t("events"), ["user_id"], "event_type", "event_id")


@query("""WITH n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM (SELECT label, p, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, p) GROUP BY label),
    v AS (SELECT label, p, avg(x) AS m, count(*) AS n FROM (SELECT label, generate_subscripts(embedding, 1) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, p)
    SELECT v.label, CAST(v.p - 1 AS INT) AS pos, v.n, round(v.m / norm, 6) AS x FROM v JOIN n ON v.label = n.label""")  # fmt: skip
def speaker_centroids(t):
    rows = vectors.centroids(t("embeddings"), ["label"], "embedding")
    return rows.select("label", "n", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


# --- ordered operators ----------------------------------------------------------------------------------------------


@query(f"SELECT user_id, event_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY start, event_id) AS BIGINT) AS session FROM (SELECT *, CASE WHEN start - lag(\"end\") OVER (PARTITION BY user_id ORDER BY start, event_id) > 3600 THEN 1 ELSE 0 END AS n FROM {TIMED})")
def gap_sessions(t):
    return ordered.gap_sessions(timed(t), ["user_id"], ["start", "event_id"], F.col("start"), F.col("end"), 3600).select("user_id", "event_id", "session")


_ISLAND = "(SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM (SELECT *, CASE WHEN turn > min(turn) OVER (PARTITION BY conv_id) AND role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS c FROM conversations))"


@query(f"SELECT conv_id AS project_id, CAST(island AS BIGINT) AS island, min(role) AS speaker, min(turn) AS first_pos, max(turn) AS last_pos, count(*) AS n, string_agg(text, '' ORDER BY turn) AS text FROM {_ISLAND} GROUP BY conv_id, island")
def merge_speaker_runs(t):
    return ordered.merge_runs(segments(t), ["project_id"], "idx", "speaker", "text")


@query(f"SELECT conv_id AS project_id, turn AS idx, CASE WHEN lead(island) OVER (PARTITION BY conv_id ORDER BY turn) <> island THEN text || chr(10) || chr(10) ELSE text END AS text FROM {_ISLAND}")
def mark_paragraphs(t):
    rows = ordered.islands(segments(t), ["project_id"], ["idx"], "speaker")
    return ordered.mark_boundaries(rows, ["project_id"], ["idx"], "island", "text").select("project_id", "idx", "text")


@query("""WITH w AS (SELECT a.user_id, a.event_id, b.event_type AS l, b.event_id AS e FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) a
    JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) b ON a.user_id = b.user_id AND b.r BETWEEN a.r - 2 AND a.r + 2)
    SELECT user_id, event_id, l AS smoothed FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY n DESC, f) AS rn FROM (SELECT user_id, event_id, l, count(*) AS n, min(e) AS f FROM w GROUP BY ALL)) WHERE rn = 1""")  # fmt: skip
def smooth_labels(t):
    return ordered.smooth_labels(t("events"), ["user_id"], "event_id", "event_type").select("user_id", "event_id", "smoothed")


@query("SELECT conv_id AS project_id, turn AS idx, 'Speaker ' || dense_rank() OVER (PARTITION BY conv_id ORDER BY f) AS renamed FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id, role) AS f FROM conversations)")
def renumber_speakers(t):
    return ordered.renumber(segments(t), ["project_id"], "idx", "speaker").select("project_id", "idx", "renamed")


@query('SELECT conv_id AS project_id, turn AS idx, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM conversations')
def char_offsets(t):
    return ordered.char_offsets(segments(t), ["project_id"], ["idx"], "text").select("project_id", "idx", "offset")


@query("SELECT event_id, CAST(unnest(CASE WHEN value / 10 >= 3 THEN range(0, CAST(floor(value / 10 - 3) AS BIGINT) + 1) ELSE [] END) AS DOUBLE) AS window_start FROM events")
def sliding_windows(t):
    return ordered.sliding_windows(t("events").select("event_id", (F.col("value") / 10).alias("d")), "d").select("event_id", "window_start")


_MARKED = sql_any("lower(text)", fixed.MARKERS_EN)
_FOLD = """WITH RECURSIVE s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, turn * 4.0 AS a, turn * 4.0 + 3.0 AS b, {marked} AS m, text FROM conversations),
    f AS (SELECT conv_id, turn, r, b, 0 AS paragraph, 1 AS n, b - a AS speech FROM s WHERE r = 1
      UNION ALL SELECT conv_id, turn, r, b, paragraph + cut, CASE WHEN cut = 1 THEN 1 ELSE n + 1 END, CASE WHEN cut = 1 THEN own ELSE speech + own END FROM (
        SELECT s.conv_id, s.turn, s.r, s.b, f.paragraph, f.n, f.speech, s.b - s.a AS own, CASE WHEN {split} THEN 1 ELSE 0 END AS cut FROM f JOIN s ON s.conv_id = f.conv_id AND s.r = f.r + 1))
    SELECT conv_id AS project_id, turn AS idx, CAST(paragraph AS BIGINT) AS paragraph FROM f"""


@query(_FOLD.format(marked=_MARKED, split="s.m AND f.n >= 2"))
def semantic_paragraphs(t):
    return blocks.paragraphs(segments(t), ["project_id"], ["idx"], _marked(), "semantic").select("project_id", "idx", "paragraph")


@query(_FOLD.format(marked=_MARKED, split="(s.a - f.b > 1.5 OR s.m OR f.speech >= 60) AND f.speech >= 5"))
def hybrid_paragraphs(t):
    start = F.col("idx") * F.lit(4.0)
    rows = segments(t).withColumns({"start": start, "end": start + 3.0})
    silence = start - F.lag(start + 3.0).over(Window.partitionBy("project_id").orderBy("idx")) > 1.5
    return blocks.paragraphs(rows, ["project_id"], ["idx"], _marked(), "hybrid", gap=F.coalesce(silence, F.lit(False))).select("project_id", "idx", "paragraph")


def _marked():
    return F.coalesce(tx.any_of(F.lower("text"), fixed.MARKERS_EN), F.lit(False))


_PLAIN = r"regexp_replace(lower(trim(text)), '[\s\.,!?;:，。！？；：、\-—\x22\x27\(\)\[\]【】「」]+', '', 'g')"
_ALIKE = """CASE WHEN {a} = '' OR {b} = '' THEN CAST({a} = {b} AS INT) ELSE list_sum(list_transform(list_distinct(string_split({a}, '')), lambda c: least(length({a}) - length(replace({a}, c, '')), length({b}) - length(replace({b}, c, ''))))) / greatest(length({a}), length({b})) END"""


@query(f"""WITH RECURSIVE s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, {_PLAIN} AS p FROM conversations),
    f AS (SELECT conv_id, turn, r, p AS head, r AS first FROM s WHERE r = 1
      UNION ALL SELECT s.conv_id, s.turn, s.r, CASE WHEN f.head <> '' AND {_ALIKE.format(a='f.head', b='s.p')} >= 0.6 THEN f.head ELSE s.p END,
        CASE WHEN f.head <> '' AND {_ALIKE.format(a='f.head', b='s.p')} >= 0.6 THEN f.first ELSE s.r END FROM f JOIN s ON s.conv_id = f.conv_id AND s.r = f.r + 1)
    SELECT conv_id AS project_id, turn AS idx, r > first AND count(*) OVER (PARTITION BY conv_id, first) >= 3 AS repeated FROM f""")  # fmt: skip
def repeated_segments(t):
    limits = fixed.SENSITIVITY["medium"]
    rows = segments(t).select("project_id", "idx", tx.comparable(F.col("text")).alias("plain"))
    return blocks.repeated(rows, ["project_id"], "idx", F.col("plain"), ordered.char_similarity, limits["repetition_ratio"], limits["min_repetition_count"]).drop("plain")


@query(f"""WITH RECURSIVE s AS (SELECT user_id, event_id, start, "end", "end" - start AS d, row_number() OVER (PARTITION BY user_id ORDER BY start, event_id) AS r FROM {TIMED}),
    f AS (SELECT user_id, event_id, r, "end", d, coalesce(d < 0 OR d > 15, false) AS odd FROM s WHERE r = 1
      UNION ALL SELECT s.user_id, s.event_id, s.r, s."end", s.d, coalesce(s.d < 0 OR s.d > 15, false) OR (NOT f.odd AND coalesce(f.d > 0 AND s.d > 0 AND greatest(f."end" - s.start, 0) / least(f.d, s.d) > 0.7, false))
        FROM f JOIN s ON s.user_id = f.user_id AND s.r = f.r + 1)
    SELECT user_id, event_id, odd FROM f""")  # fmt: skip
def overlapping_segments(t):
    return ordered.time_flags(timed(t), ["user_id"], ["start", "event_id"], 15.0, fixed.SENSITIVITY["medium"]["max_overlap_ratio"]).select("user_id", "event_id", "odd")


@query("""WITH RECURSIVE s AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
    f AS (SELECT conv_id, turn, r, n AS held, 0 AS chunk FROM s WHERE r = 1
      UNION ALL SELECT s.conv_id, s.turn, s.r, CASE WHEN f.held + s.n + 1 > 500 THEN s.n ELSE f.held + s.n + 1 END, f.chunk + CASE WHEN f.held + s.n + 1 > 500 THEN 1 ELSE 0 END FROM f JOIN s ON s.conv_id = f.conv_id AND s.r = f.r + 1)
    SELECT conv_id AS project_id, turn AS idx, CAST(chunk AS BIGINT) AS chunk FROM f""")  # fmt: skip
def pack_segments(t):
    return blocks.packed(segments(t), ["project_id"], ["idx"], F.length(F.coalesce("text", F.lit(""))), 500).select("project_id", "idx", "chunk")


# --- text -----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {sql_any('lower(text)', [p.lower() for p in fixed.BLOCKED_ZH + fixed.BLOCKED_EN])} AS template FROM documents")
def template_phrases(t):
    return t("documents").select("doc_id", tx.template_phrase(F.col("text")).alias("template"))


@query(rf"""SELECT doc_id, length(s) >= 4 AND c + l > 0 AND CASE WHEN c + l = 0 THEN 0 ELSE c / (c + l) END < 0.2 AND l > 10 AS switched FROM (SELECT doc_id, s,
    len(regexp_extract_all(s, '[{fixed.CJK_WIDE}]')) AS c, length(array_to_string(regexp_extract_all(s, '[a-zA-Z]{{2,}}'), '')) AS l
    FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents))""")  # fmt: skip
def language_switches(t):
    return t("documents").select("doc_id", tx.language_switch(F.col("text"), True).alias("switched"))


@query("SELECT event_id, value < 0 OR value / 10 > 5 AS odd FROM events")
def odd_times(t):
    return t("events").select("event_id", tx.odd_times(F.lit(0.0), F.col("value") / 10, 5.0).alias("odd"))


@query(f"SELECT conv_id, turn, CASE WHEN {sql_any('lower(text)', fixed.STATS_KEYWORDS)} THEN 'stats' WHEN {sql_any('lower(text)', fixed.ACTION_KEYWORDS)} THEN 'action_items' WHEN {sql_any('lower(text)', fixed.SPEAKER_KEYWORDS)} THEN 'speaker' ELSE 'search' END AS route FROM conversations")
def route_questions(t):
    return t("conversations").select("conv_id", "turn", tx.route_question(F.col("text")).alias("route"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '([\x{4E00}-\x{9FFF}]{2,}|[a-zA-Z]{3,}|[0-9]+)', 1)) AS n FROM documents")
def keyword_counts(t):
    return t("documents").select("doc_id", F.size(tx.keywords(F.col("text"))).cast("long").alias("n"))


@query("SELECT event_id, printf('%02d:%02d', CAST(floor(value * 10 / 60) AS BIGINT), CAST(floor(value * 10) AS BIGINT) % 60) AS clock FROM events")
def clock_times(t):
    return t("events").select("event_id", tx.clock(F.col("value") * 10).alias("clock"))


@query("SELECT event_id, translate(CAST(event_id AS VARCHAR), '0123456789', '零一二三四五六七八九') AS digits FROM events")
def digit_words(t):
    return t("events").select("event_id", tx.chinese_digits(F.col("event_id").cast("string")).alias("digits"))


_EN = ", ".join(f"'{w}'" for w in fixed.FILLER_LANGUAGES_EN)


@query(rf"SELECT doc_id, round(least(coalesce(list_sum(list_transform(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda w: w IN ({_EN})), lambda w: length(w))), 0) / greatest(length(text), 1), 1.0), 9) AS density FROM documents")
def filler_density(t):
    return t("documents").select("doc_id", F.round(tx.filler_density_en(F.col("text")), 9).alias("density"))


_HALL = " + ".join(f"len(regexp_extract_all(text, '(?i){p}'))" for p in fixed.HALLUCINATIONS)


@query(f"SELECT doc_id, CAST({_HALL} AS BIGINT) AS n FROM documents")
def hallucination_counts(t):
    return t("documents").select("doc_id", tx.hallucination_count(F.col("text")).alias("n"))


_READABLE = f"greatest(0.0, 1 - 0.4 * d - least(0.1 * ({_HALL}), 0.3))"


@query(rf"""SELECT doc_id, round(d, 9) AS filler_density, CASE WHEN regexp_matches(text, '[\x{{4E00}}-\x{{9FFF}}]') THEN NULL ELSE CAST(0 AS DOUBLE) END AS repetition_density, CAST({_HALL} AS BIGINT) AS hallucination_count,
    round(CASE WHEN trim(text) = '' THEN 0 ELSE {_READABLE} END, 9) AS readability FROM (SELECT doc_id, text, least(coalesce(list_sum(list_transform(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r]+'), lambda w: w IN ({_EN})), lambda w: length(w))), 0) / greatest(length(text), 1), 1.0) AS d FROM documents)""")  # fmt: skip
def readability_scores(t):
    """The SQL has no back-references: it can say that texts without ideographs repeat none, and the given ones have none."""
    rows = t("documents").select("doc_id", tx.transcript_scores(F.col("text"), False).alias("s"))
    return rows.select("doc_id", F.round("s.filler_density", 9).alias("filler_density"), "s.repetition_density", "s.hallucination_count", F.round("s.readability", 9).alias("readability"))


@query()
def cleaned_text(t):
    c = tx.filtered(F.col("text"), False)
    return t("conversations").select("conv_id", "turn", c.alias("text")).filter("trim(text) <> ''")


@query(r"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE regexp_matches(text, '\S')),
    c AS (SELECT doc_id, text, n, 0 AS k, CAST(0 AS BIGINT) AS a, CASE WHEN n <= 500 THEN n ELSE 450 + CASE WHEN m > 0 THEN m ELSE 50 END END AS b FROM (SELECT *, length(regexp_extract(substr(text, 451, 50), '(?s)^.*[。！？.!?\n]')) AS m FROM d)
      UNION ALL SELECT doc_id, text, n, k + 1, a, CASE WHEN e >= n THEN n ELSE e - 50 + CASE WHEN m > 0 THEN m ELSE 50 END END FROM (
        SELECT *, length(regexp_extract(substr(text, e - 49, 50), '(?s)^.*[。！？.!?\n]')) AS m FROM (SELECT doc_id, text, n, k, b - 50 AS a, b - 50 + 500 AS e FROM c WHERE b < n))),
    p AS (SELECT doc_id, k, CASE WHEN n <= 500 THEN text ELSE regexp_replace(substr(text, a + 1, b - a), '^\s+|\s+$', '', 'g') END AS text FROM c)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS chunk, text FROM p WHERE text <> ''""")  # fmt: skip
def document_chunks(t):
    return knowledge.text_chunks(t("documents").select("doc_id", F.col("text").alias("whole")), "whole", "chunk", "text")


# --- vectors --------------------------------------------------------------------------------------------------------

_Q = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_QSQL = "[" + ", ".join(map(str, _Q)) + "]::DOUBLE[]"


@query(f"SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), {_QSQL}), 6) AS distance FROM embeddings ORDER BY list_distance(CAST(embedding AS DOUBLE[]), {_QSQL}), vec_id LIMIT 5")
def nearest_vectors(t):
    return vectors.knn(t("embeddings"), _Q, 5).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, row_number() OVER (ORDER BY d, vec_id) AS rank, 0.0::DOUBLE AS score FROM (SELECT vec_id, d FROM (SELECT vec_id, list_distance(CAST(embedding AS DOUBLE[]), {_QSQL}) AS d FROM embeddings WHERE label IN (1, 2)) ORDER BY d, vec_id LIMIT 15) ORDER BY d, vec_id LIMIT 5")
def rerank_fallback(t):
    got = vectors.knn(relational.optional_in(t("embeddings"), "label", [1, 2]), _Q, 15)
    rank = F.row_number().over(Window.orderBy("distance", "vec_id"))  # of 3 * k rows
    return got.withColumn("rank", rank.cast("long")).filter("rank <= 5").select("vec_id", "rank", F.lit(0.0).alias("score"))


@query(f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_QSQL}), 6) AS cosine FROM embeddings")
def cosine_scores(t):
    q = F.array(*map(F.lit, _Q))
    return t("embeddings").select("vec_id", F.round(vectors.cosine(vectors.doubles(F.col("embedding")), q), 6).alias("cosine"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, vec_id = min(vec_id) OVER (PARTITION BY label) AS known FROM embeddings),
    s AS (SELECT q.vec_id AS qid, l.vec_id AS lid, list_cosine_similarity(q.e, l.e) AS s FROM v q JOIN v l ON l.known AND NOT q.known AND len(q.e) = len(l.e)),
    b AS (SELECT * FROM s WHERE s > -1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, lid) = 1)
    SELECT v.vec_id AS qid, b.lid, round(b.s, 6) AS score, coalesce(b.s >= 0.3, false) AS matched FROM v LEFT JOIN b ON v.vec_id = b.qid WHERE NOT v.known""")  # fmt: skip
def match_voiceprints(t):
    v = t("embeddings").select("vec_id", "label", vectors.doubles(F.col("embedding")).alias("v"))
    known = v.groupBy("label").agg(F.min("vec_id").alias("lid"), F.min_by("v", "vec_id").alias("lvec"))  # a voiceprint a label
    others = v.join(known.select(F.col("lid").alias("vec_id")), "vec_id", "left_anti").select(F.col("vec_id").alias("qid"), F.col("v").alias("qvec"))
    return vectors.best_match(others, known.select("lid", "lvec"), 0.3).withColumn("score", F.round("score", 6)).drop("blocks")


def _sql_unit(values: str) -> str:
    return f"list_transform({values}, lambda x: x / sqrt(list_sum(list_transform({values}, lambda y: y * y))))"


@query(f"""WITH p AS (SELECT label, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS a, CAST(arg_max(embedding, vec_id) AS DOUBLE[]) AS b FROM embeddings GROUP BY label),
    m AS (SELECT label, list_transform(list_zip(a, b), lambda z: (z[1] * 3 + z[2]) / 4) AS m, list_transform(list_zip(a, b), lambda z: z[1] * 20 / 21 + z[2] / 21) AS e FROM p)
    SELECT label, CAST(unnest(range(len(m))) AS INT) AS pos, round(unnest({_sql_unit('m')}), 6) AS merged, round(unnest({_sql_unit('e')}), 6) AS blended FROM m""")  # fmt: skip
def merged_voiceprints(t):
    v = vectors.doubles(F.col("embedding"))
    rows = t("embeddings").select("label", "vec_id", v.alias("v"))
    pair = rows.groupBy("label").agg(F.min_by("v", "vec_id").alias("a"), F.max_by("v", "vec_id").alias("b"))
    both = F.arrays_zip(vectors.weighted_merge(F.col("a"), F.lit(3.0), F.col("b"), F.lit(1.0)).alias("m"), vectors.blend(F.col("a"), F.lit(30), F.col("b")).alias("e"))
    return pair.select("label", F.posexplode(both).alias("pos", "x")).select("label", "pos", F.round("x.m", 6).alias("merged"), F.round("x.e", 6).alias("blended"))


RECORDING = 256  # vectors of consecutive ids that stand for one recording


@query()
def cluster_voiceprints(t):
    rows = t("embeddings").withColumn("recording", F.floor(F.col("vec_id") / RECORDING))
    return vectors.cluster_within(rows, "recording", "vec_id", "embedding", 0.55)
