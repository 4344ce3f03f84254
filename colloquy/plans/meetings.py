"""The queries beyond the catalog: exports, retrieval, corrections, voiceprints, changes of the store.

Turns of a conversation stand for timed segments: turn k starts at 4 k seconds and lasts three.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import text as tx
from ..operators import audio, blocks, correction, evaluation, exports, intervals, knowledge, ordered, relational, steps, summaries as sm, vectors
from ..sources import index, store, wav
from ..sources.shared import new_path, written
from .catalog import _FOLD, micros, query, segments, sql_any

_SEGMENTS = "(SELECT conv_id AS project_id, turn AS idx, role AS speaker, text, CAST(turn * 4 AS DOUBLE) AS start, CAST(turn * 4 + 3 AS DOUBLE) AS \"end\" FROM conversations)"


def spoken(t) -> DataFrame:
    start = F.col("idx") * F.lit(4.0)
    return segments(t).withColumns({"start": start, "end": start + 3.0})


# --- exports --------------------------------------------------------------------------------------------------------

_CLOCK = "printf('%02d:%02d', CAST(start AS BIGINT) // 60, CAST(start AS BIGINT) % 60)"
_JOIN = "SELECT project_id, {head}string_agg({line}, chr(10) ORDER BY idx) AS body FROM {rows} GROUP BY project_id"


@query(_JOIN.format(head="", line=f"'[' || {_CLOCK} || '] ' || CASE WHEN coalesce(speaker, '') = '' THEN '' ELSE '[' || speaker || '] ' END || coalesce(text, '')", rows=_SEGMENTS))
def export_text(t):
    return exports.plain_text(spoken(t))


@query(_JOIN.format(head="'| Time | Speaker | Text |' || chr(10) || '|------|---------|------|' || chr(10) || ", rows=_SEGMENTS,
    line=f"'| ' || {_CLOCK} || ' | ' || replace(replace(coalesce(speaker, ''), '|', '\\|'), chr(10), ' ') || ' | ' || replace(replace(coalesce(text, ''), '|', '\\|'), chr(10), ' ') || ' |'"))
def export_table(t):
    return exports.markdown_table(spoken(t))


_TOPICS = "(SELECT conv_id AS project_id, arg_min(role, turn) AS topic, list(role ORDER BY turn) AS conclusions FROM conversations WHERE turn < 2 GROUP BY conv_id)"


def summaries(t) -> DataFrame:
    """A summary of every meeting's first two turns: their roles are its topic and conclusions."""
    first = segments(t).filter("idx < 2").groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("idx", "speaker"))).alias("s"))
    roles = F.transform("s", lambda x: x["speaker"])
    items = F.array(F.struct(F.lit("Follow up").alias("action"), F.get("s", 0)["speaker"].alias("owner"), F.lit("").alias("deadline")))
    return first.select("project_id", F.struct(F.get(roles, 0).alias("topic"), roles.alias("conclusions"), items.alias("action_items"), F.lit("").alias("discussion")).alias("summary"))


@query(f"""SELECT r.project_id, '# ' || topic || chr(10) || chr(10) || '## Conclusions' || chr(10) || chr(10) || array_to_string(list_transform(conclusions, lambda c: '- ' || c), chr(10)) || chr(10) || chr(10)
    || '## Action Items' || chr(10) || chr(10) || '- [ ] Follow up (@' || topic || ')' || chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10) || body AS body
    FROM (SELECT project_id, string_agg('`[' || {_CLOCK} || ']` **' || speaker || '**: ' || text || chr(10), chr(10) ORDER BY idx) AS body FROM {_SEGMENTS} GROUP BY project_id) r JOIN {_TOPICS} s ON r.project_id = s.project_id""")  # fmt: skip
def export_markdown(t):
    return exports.markdown(spoken(t), summaries(t))


@query(f"""SELECT r.project_id, n, first, topic FROM (SELECT project_id, CAST(count(*) AS BIGINT) AS n, arg_min(text, idx) AS first FROM {_SEGMENTS} GROUP BY project_id) r JOIN {_TOPICS} s ON r.project_id = s.project_id""")
def export_json(t):
    """The exported documents, read back: their segments, the first one's text, and the summary's topic."""
    body = F.from_json("body", "segments array<struct<start:double,end:double,text:string,speaker:string>>, summary struct<topic:string>")
    return exports.json_document(spoken(t), summaries(t)).select("project_id", body.alias("d")).select("project_id", F.size("d.segments").cast("long").alias("n"), F.get("d.segments", 0)["text"].alias("first"), "d.summary.topic")


_LINES = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY idx, k) - 1 AS idx, line AS text, speaker FROM
    (SELECT project_id, idx, speaker, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS k FROM {_SEGMENTS})""")  # fmt: skip
def markdown_round_trip(t):
    return exports.read_markdown(exports.speaker_markdown(spoken(t)), spoken(t)).select("project_id", "idx", "text", "speaker")


# --- the knowledge base ---------------------------------------------------------------------------------------------

_PACKED = f"""WITH RECURSIVE s AS (SELECT project_id, idx, speaker, start, "end", trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS x, row_number() OVER (PARTITION BY project_id ORDER BY idx) AS r FROM {_SEGMENTS} WHERE regexp_matches(text, '\\S')),
    f AS (SELECT project_id, r, x, start, "end", speaker, length(x) + 1 AS held, 0 AS position FROM s WHERE r = 1
      UNION ALL SELECT s.project_id, s.r, s.x, s.start, s."end", s.speaker, CASE WHEN f.held + length(s.x) > 500 THEN length(s.x) + 1 ELSE f.held + length(s.x) + 1 END,
        f.position + CASE WHEN f.held + length(s.x) > 500 THEN 1 ELSE 0 END FROM f JOIN s ON s.project_id = f.project_id AND s.r = f.r + 1),
    g AS (SELECT project_id, position, string_agg(x, ' ' ORDER BY r) AS text, CAST(min(start) AS DOUBLE) AS start_time, arg_min(speaker, r) AS speaker, arg_min("end", r) AS closes FROM f GROUP BY project_id, position)
    SELECT project_id, CAST(position AS INT) AS position, text, start_time, CAST(lead(closes) OVER (PARTITION BY project_id ORDER BY position) AS DOUBLE) AS end_time, speaker FROM g"""


@query(_PACKED)
def segment_chunks(t):
    return knowledge.segment_chunks(spoken(t))


def indexed(t, some: str = "true") -> tuple[DataFrame, DataFrame]:
    """Documents are projects (those of source src0 folders; some of them, if asked for) with their text as note; conversations are their segments."""
    projects = t("documents").select(F.col("doc_id").alias("project_id"), (F.col("source") == "src0").alias("is_folder"), F.col("lang").alias("title")).filter(some)
    notes = t("documents").select(F.col("doc_id").alias("project_id"), "text")
    briefs = t("benchmark").select(F.col("item_id").alias("project_id"), F.col("text").alias("raw_markdown"), F.lit("benchmark").alias("topic"))
    files = t("benchmark").select(F.col("item_id").alias("project_id"), F.concat(F.lit("item-"), F.col("item_id"), F.lit(".txt")).alias("filename"), "text")
    return projects, knowledge.index_chunks(projects, spoken(t), briefs, notes, files)


_CUT = r"length(regexp_extract(substr(text, {at}, 50), '(?s)^.*[。！？.!?\n]'))"


def _chunk_texts(rows: str, kind: str, metadata: str) -> str:
    """The chunks of each text, as chunk_text() makes them."""
    return rf"""SELECT project_id, '{kind}' AS source_type, {metadata} AS metadata_json, x AS text FROM (WITH RECURSIVE d AS (SELECT *, length(text) AS n FROM {rows} WHERE regexp_matches(text, '\S')),
      c AS (SELECT *, CAST(0 AS BIGINT) AS a, CASE WHEN n <= 500 THEN n ELSE 450 + CASE WHEN {_CUT.format(at=451)} > 0 THEN {_CUT.format(at=451)} ELSE 50 END END AS b FROM d
        UNION ALL SELECT * EXCLUDE (a, b), b - 50, CASE WHEN b + 450 >= n THEN n ELSE b + 400 + CASE WHEN {_CUT.format(at='b + 401')} > 0 THEN {_CUT.format(at='b + 401')} ELSE 50 END END FROM c WHERE b < n)
      SELECT *, CASE WHEN n <= 500 THEN text ELSE trim(substr(text, a + 1, b - a), ' ' || chr(9) || chr(10) || chr(13)) END AS x FROM c) WHERE x <> ''"""


_GRAMS = " UNION ALL ".join(
    f"SELECT c, {n} + " + " + ".join(f"{31**k} * p[i + {k}]" for k in range(n)) + f" AS h FROM (SELECT c, p, unnest(range(1, len(p) - {n} + 2)) AS i FROM p)" for n in (1, 2, 3)
)
_NONE = "'{}'"
_TOPIC = """'{"topic":"benchmark"}'"""
_FILENAME = """'{"filename":"' || filename || '"}'"""
_NOTES = "(SELECT doc_id AS project_id, text FROM documents WHERE source <> 'src0' AND doc_id % 10 <> 2)"
_FILES = "(SELECT item_id AS project_id, 'item-' || item_id || '.txt' AS filename, text FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents WHERE source <> 'src0') AND item_id % 10 NOT IN (2, 3))"


@query(f"""WITH chunks AS (
      SELECT project_id, 'segment' AS source_type, '{{"start_time":' || start_time || ',' || CASE WHEN end_time IS NULL THEN '' ELSE '"end_time":' || end_time || ',' END || '"speaker":"' || speaker || '"}}' AS metadata_json, text
        FROM ({_PACKED}) WHERE project_id IN (SELECT doc_id FROM documents WHERE source <> 'src0') AND project_id % 10 NOT IN (2, 3)
      UNION ALL {_chunk_texts(_NOTES, 'note', _NONE)}
      UNION ALL {_chunk_texts(_FILES, 'summary', _TOPIC)}
      UNION ALL {_chunk_texts(_FILES, 'attachment', _FILENAME)}
      UNION ALL {_chunk_texts('(SELECT * FROM ' + _FILES + ' WHERE project_id % 10 = 4)', 'attachment', _FILENAME)}),
    own AS (SELECT *, row_number() OVER () AS c FROM chunks),
    p AS (SELECT c, list_transform(range(1, length(text) + 1), lambda i: CAST(unicode(substr(text, i, 1)) AS BIGINT)) AS p FROM own),
    v AS (SELECT c, h % 64 AS place, sum(CASE WHEN h % 8191 % 2 = 0 THEN 1 ELSE -1 END) AS x FROM ({_GRAMS}) GROUP BY ALL)
    SELECT project_id, source_type, metadata_json, text, CAST(n_places AS BIGINT) AS n_places, CAST(top_place AS BIGINT) AS top_place FROM own
      JOIN (SELECT c, count(*) FILTER (x <> 0) AS n_places, arg_min(place, -abs(x) * 1000 + place) AS top_place FROM v GROUP BY c) USING (c)""")  # fmt: skip
def indexed_projects(t):
    """Projects are indexed with a hashed embedder, in one commit. Then some lose all but their note, some are deleted, and the files of some are
    appended once more."""
    spark = t("documents").sparkSession
    path = new_path(spark, "index")

    def embedded(some: str, kind: str = "true") -> tuple[DataFrame, DataFrame]:
        """Chunks of a kind, and their projects. Few are embedded twice, so that no table but the index holds all."""
        projects, chunks = indexed(t, some)
        return index.embed(chunks.filter(kind).withColumn("id", index.chunk_id()), lambda: index.HashedGrams(64), "hashed-64"), projects

    index.replace_projects(*embedded("true"), path)
    index.replace_projects(*embedded("project_id % 10 = 3", "source_type = 'note'"), path)
    index.delete_projects(indexed(t, "project_id % 10 = 2")[0], path)
    index.append_chunks(embedded("project_id % 10 = 4", "source_type = 'attachment'")[0], path)
    places = F.array_min(F.transform("vector", lambda x, i: F.struct((-F.abs(x)).alias("x"), i.alias("i"))))["i"]
    return index.chunks_of(spark, path).select("project_id", "source_type", "metadata_json", "text", F.size(F.filter("vector", lambda x: x != 0)).cast("long").alias("n_places"), places.cast("long").alias("top_place"))


def _chunk_counts(rows: str) -> str:
    """Chunks of each text by the number of cuts, as chunk_text() makes them."""
    mark = r"length(regexp_extract(substr(text, {at}, 50), '(?s)^.*[。！？.!?\n]'))"
    return rf"""(WITH RECURSIVE d AS (SELECT *, length(text) AS n FROM {rows} WHERE regexp_matches(text, '\S')),
      c AS (SELECT project_id, text, n, CAST(0 AS BIGINT) AS a, CASE WHEN n <= 500 THEN n ELSE 450 + CASE WHEN {mark.format(at=451)} > 0 THEN {mark.format(at=451)} ELSE 50 END END AS b FROM d
        UNION ALL SELECT project_id, text, n, b - 50, CASE WHEN b + 450 >= n THEN n ELSE b + 400 + CASE WHEN {mark.format(at='b + 401')} > 0 THEN {mark.format(at='b + 401')} ELSE 50 END END FROM c WHERE b < n)
      SELECT project_id, count(*) FILTER (regexp_matches(substr(text, a + 1, b - a), '\S')) AS k FROM c GROUP BY project_id)"""


@query(f"""SELECT d.doc_id AS project_id, CAST(coalesce(s.k, 0) + coalesce(n.k, 0) + 2 * coalesce(b.k, 0) AS BIGINT) AS chunks FROM documents d
    LEFT JOIN (SELECT project_id, count(*) AS k FROM ({_PACKED}) GROUP BY project_id) s ON d.doc_id = s.project_id
    LEFT JOIN {_chunk_counts('(SELECT doc_id AS project_id, text FROM documents)')} n ON d.doc_id = n.project_id
    LEFT JOIN {_chunk_counts('(SELECT item_id AS project_id, text FROM benchmark)')} b ON d.doc_id = b.project_id
    WHERE d.source <> 'src0'""")  # fmt: skip
def index_counts(t):
    return knowledge.index_counts(*indexed(t))


@query(f"SELECT CAST(sum(chunks) AS BIGINT) AS total, count(*) AS projects FROM (SELECT count(*) AS chunks, project_id FROM ({_PACKED}) GROUP BY project_id)")
def index_total(t):
    return knowledge.segment_chunks(spoken(t)).groupBy("project_id").count().agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("projects"))


_Q = [((i * 29) % 17 - 8) / 10 for i in range(64)]
_QSQL = "[" + ", ".join(map(str, _Q)) + "]::DOUBLE[]"
_FOUND = f"""SELECT vec_id AS chunk_id, label AS project_id, n_name, d, row_number() OVER (ORDER BY d, label, vec_id) - 1 AS ordinal FROM
    (SELECT vec_id, label, n_name, list_distance(CAST(embedding AS DOUBLE[]), {_QSQL}) AS d FROM embeddings LEFT JOIN nation ON label = n_nationkey) ORDER BY d, label, vec_id LIMIT 15"""


def _found(t, fetch: int) -> DataFrame:
    chunks = t("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("project_id"), F.col("embedding").alias("vector"), F.lit("note").alias("source_type"), F.concat(F.lit("chunk "), F.col("vec_id")).alias("text"))
    names = t("nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("title"))
    return knowledge.search(chunks, F.array(*map(F.lit, _Q)), names, 5, fetch)


@query(f"SELECT chunk_id, ordinal, coalesce(n_name, 'Unknown') AS project_title, round(d, 6) AS score FROM ({_FOUND})")
def search_knowledge(t):
    return _found(t, 15).select("chunk_id", "ordinal", "project_title", F.round("score", 6).alias("score"))


@query(f"SELECT n.n_nationkey AS rank, f.chunk_id, CAST(1.0 / (1 + n.n_nationkey) AS DOUBLE) AS score FROM nation n JOIN ({_FOUND}) f ON f.ordinal = (n.n_nationkey * 7) % 19 WHERE n.n_nationkey < 5")
def rerank_join(t):
    """A reranker's answer of five ordinals, some of them beyond the rows found."""
    key = F.col("n_nationkey")
    ranking = t("nation").filter(key < 5).select(key.alias("rank"), ((key * 7) % 19).cast("long").alias("ordinal"), (F.lit(1.0) / (1 + key)).alias("relevance"))
    return knowledge.reranked(_found(t, 15), ranking).select("rank", "chunk_id", "score")


class _Digits:
    """A reranker that likes some numbers better; it can't answer some questions, alone or among others."""

    def rank(self, asked):
        if any(q.endswith("IA") for q, _ in asked):
            raise RuntimeError("no answer")
        return [[(i, int(t.split()[1]) * 37 % 101 / 101) for i, t in enumerate(texts)] for _, texts in asked]


@query("""WITH h AS (SELECT label, vec_id, n_name, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS ordinal FROM embeddings JOIN nation ON label = n_nationkey),
    s AS (SELECT *, n_name LIKE '%IA' AS fallback, CASE WHEN n_name LIKE '%IA' THEN NULL ELSE vec_id * 37 % 101 / CAST(101 AS DOUBLE) END AS r FROM h WHERE ordinal < 15)
    SELECT label, row_number() OVER (PARTITION BY label ORDER BY r DESC, ordinal) - 1 AS rank, ordinal, r AS relevance, fallback FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY r DESC, ordinal) <= 5""")
def reranked_search(t):
    """Each nation's first fifteen vectors in a reranker's order, the best five; questions that it can't answer keep the search's."""
    names = t("nation").select(F.col("n_nationkey").alias("label"), "n_name")
    hits = t("embeddings").join(names, "label").select("label", "n_name", "vec_id", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).cast("long") - 1).alias("ordinal")).filter("ordinal < 15")
    found = hits.withColumn("text", F.concat(F.lit("chunk "), "vec_id"))
    return knowledge.rerank(found, "label", "n_name", _Digits, "digits", 5).drop("text")


@query(f"""SELECT 'search' AS question, '相关内容：' || chr(10) || string_agg(chr(10) || '[' || coalesce(n_name, 'Unknown') || ' - note]' || chr(10) || 'chunk ' || chunk_id || chr(10), '' ORDER BY ordinal) AS context FROM ({_FOUND}) WHERE ordinal < 5""")
def retrieved_context(t):
    return knowledge.context(_found(t, 5).withColumn("question", F.lit("search")), ["question"])


def _answers(t) -> DataFrame:
    """A model's answer about each meeting: fenced JSON of its first two turns' roles, or, for odd ones, no JSON at all."""
    first = segments(t).filter("idx < 2").groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("idx", "speaker"))).alias("s"))
    roles = F.transform("s", lambda x: x["speaker"])
    body = F.to_json(F.struct(F.get(roles, 0).alias("topic"), roles.alias("conclusions"), F.array(F.struct(F.lit("Ann").alias("assignee"), F.lit("write").alias("task"))).alias("action_items")))
    return first.select("project_id", F.when(F.col("project_id") % 2 == 1, "no JSON").otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("answer"))


@query(f"""SELECT project_id, CASE WHEN project_id % 2 = 1 THEN '' ELSE topic END AS topic, CASE WHEN project_id % 2 = 1 THEN 'no JSON' ELSE '# ' || topic || chr(10) || chr(10) || '## 结论' || chr(10) || chr(10)
    || array_to_string(list_transform(conclusions, lambda c: '- ' || c), chr(10)) || chr(10) || chr(10) || '## 待办事项' || chr(10) || chr(10) || '- [ ] write (@Ann)' || chr(10) END AS raw FROM {_TOPICS}""")  # fmt: skip
def parsed_summaries(t):
    return _answers(t).select("project_id", sm.parsed(F.col("answer")).alias("s")).select("project_id", "s.topic", "s.raw")


@query(f"""WITH s AS (SELECT * FROM {_TOPICS} WHERE project_id % 2 = 0), l AS (SELECT project_id, unnest(conclusions) AS label, unnest(range(len(conclusions))) AS i, len(conclusions) AS n FROM s)
    SELECT project_id, 'root' AS id, NULL AS parent, topic AS label, CAST(0 AS DOUBLE) AS x, ((len(conclusions) - 1) * 28.0 + len(conclusions) * 56.0)::DOUBLE / 2 AS y FROM s
    UNION ALL SELECT project_id, 'conclusions', 'root', '结论', 360, (len(conclusions) - 1) * 28.0 FROM s UNION ALL SELECT project_id, 'actions', 'root', '待办事项', 360, len(conclusions) * 56.0 FROM s
    UNION ALL SELECT project_id, 'conclusion-' || i, 'conclusions', label, 680, i * 56.0 FROM l UNION ALL SELECT project_id, 'action-0', 'actions', 'Ann: write', 680, len(conclusions) * 56.0 FROM s""")  # fmt: skip
def summary_trees(t):
    """Labels of one line: every node is 40 high, and nodes are 16 apart."""
    rows = _answers(t).filter("project_id % 2 = 0").select("project_id", sm.parsed(F.col("answer")).alias("summary"))
    return sm.layout(sm.tree(rows, "project_id"), "project_id").select("project_id", "id", "parent", "label", "x", "y")


# --- corrections and alignment --------------------------------------------------------------------------------------


@query(f"""SELECT project_id, idx, CASE WHEN idx % 3 = 0 AND trim(regexp_extract(text, '^[^\\n]*')) <> '' THEN 'late ' || trim(regexp_extract(text, '^[^\\n]*')) WHEN idx % 2 = 0 AND trim(regexp_extract(text, '^[^\\n]*')) <> '' THEN 'new ' || trim(regexp_extract(text, '^[^\\n]*')) ELSE text END AS text FROM {_SEGMENTS}""")
def corrected_segments(t):
    """Answers of two chunks, with thoughts before the numbered lines; the second chunk's word is the last."""
    rows = spoken(t)
    said = F.trim(F.regexp_extract("text", r"^[^\n]*", 0))
    answer = lambda word: F.concat(F.lit("<think>[0] not this\n</think>\n["), F.col("idx"), F.lit(f"] {word} "), said)
    one = rows.filter((F.col("idx") % 2 == 0) & (said != "")).select("project_id", F.lit(0).alias("chunk"), answer("new").alias("answer"))
    two = rows.filter((F.col("idx") % 3 == 0) & (said != "")).select("project_id", F.lit(1).alias("chunk"), answer("late").alias("answer"))
    return correction.corrected(rows, one.unionByName(two), ["project_id"]).select("project_id", "idx", "text")


@query(r"""WITH RECURSIVE p AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '(?s)[^。！？.!?，,；;]*[。！？.!?，,；;]|[^。！？.!?，,；;]+$')) AS part, generate_subscripts(regexp_extract_all(text, '(?s)[^。！？.!?，,；;]*[。！？.!?，,；;]|[^。！？.!?，,；;]+$'), 1) AS k FROM conversations),
    m AS (SELECT *, sum(CASE WHEN k = 1 OR length(regexp_replace(part, '^\s+|\s+$', '', 'g')) >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY k) AS s FROM p)
    SELECT conv_id, turn, CAST(s - 1 AS INT) AS place, string_agg(part, '' ORDER BY k) AS sentence FROM m GROUP BY conv_id, turn, s""")  # fmt: skip
def split_sentences(t):
    rows = t("conversations").filter("text <> ''")
    return rows.select("conv_id", "turn", F.posexplode(tx.sentences(F.col("text"))).alias("place", "sentence"))


_UNITS = r"CAST(len(regexp_extract_all(text, '[A-Za-z0-9]+')) AS BIGINT)"


@query(f"""SELECT project_id, idx, CASE WHEN n > 0 THEN (e - n) * CAST(0.5 AS DOUBLE) END AS start, CASE WHEN n > 0 THEN (e - 1) * CAST(0.5 AS DOUBLE) + CAST(0.4 AS DOUBLE) END AS "end" FROM
    (SELECT project_id, idx, {_UNITS} AS n, CAST(sum({_UNITS}) OVER (PARTITION BY project_id ORDER BY idx) AS BIGINT) AS e FROM {_SEGMENTS})""")  # fmt: skip
def aligned_sentences(t):
    """The items are a meeting's own units, one each half second. Texts without ideographs: the SQL counts other units only."""
    rows = spoken(t).select("project_id", "idx", "text")
    count = rows.groupBy("project_id").agg(F.sum(correction.units(F.col("text"))).alias("n")).filter("n > 0")
    some = count.select("project_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(4096).cast("long"))).alias("a"))
    items = some.select("project_id", F.explode(F.sequence(F.col("a"), F.least(F.col("a") + 4096, "n") - 1)).alias("pos")).withColumns({"start": F.col("pos") * F.lit(0.5), "end": F.col("pos") * F.lit(0.5) + 0.4})
    return correction.align(rows, items, ["project_id"]).select("project_id", "idx", "start", "end")


@query(f"""WITH a AS (SELECT project_id, idx, start, "end", coalesce(sum(length(text)) OVER w, 0) AS c, sum(length(text)) OVER (PARTITION BY project_id) AS total, max("end") OVER (PARTITION BY project_id) AS last FROM {_SEGMENTS} WINDOW w AS (PARTITION BY project_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    anchors AS (SELECT project_id, c AS pos, min(start) AS time FROM a GROUP BY ALL UNION ALL SELECT DISTINCT project_id, total, last FROM a),
    p AS (SELECT project_id, idx, c + 7.0 AS at FROM a),
    b AS (SELECT p.project_id, p.idx, max(pos) AS p0, arg_max(time, pos) AS t0 FROM p JOIN anchors x ON p.project_id = x.project_id AND x.pos < p.at GROUP BY ALL),
    f AS (SELECT p.project_id, p.idx, min(pos) AS p1, arg_min(time, pos) AS t1 FROM p JOIN anchors x ON p.project_id = x.project_id AND x.pos >= p.at GROUP BY ALL)
    SELECT p.project_id, p.idx, round(CASE WHEN f.p1 IS NULL THEN b.t0 WHEN f.p1 = p.at OR b.p0 IS NULL THEN f.t1 ELSE b.t0 + (f.t1 - b.t0) * (p.at - b.p0) / (f.p1 - b.p0) END, 9) AS time
    FROM p LEFT JOIN b USING (project_id, idx) LEFT JOIN f USING (project_id, idx)""")  # fmt: skip
def interpolated_times(t):
    """The time of the eighth character of each segment, and of those after it, from the segments' starts and the meeting's end."""
    rows = ordered.char_offsets(spoken(t), ["project_id"], ["idx"], "text")
    ends = rows.groupBy("project_id").agg(F.max_by(F.col("offset") + F.length("text"), "idx").cast("double").alias("pos"), F.max("end").alias("time"))
    anchors = rows.select("project_id", F.col("offset").cast("double").alias("pos"), F.col("start").alias("time")).unionByName(ends)
    points = rows.select("project_id", "idx", (F.col("offset") + 7.0).alias("at"))
    return intervals.interpolate(points, anchors, ["project_id"]).select("project_id", "idx", F.round("time", 9).alias("time"))


# --- cleaning and scores --------------------------------------------------------------------------------------------


@query()
def filtered_transcripts(t):
    """The transcript clean-up as one plan: doubtful segments go, numbers are rewritten, fillers and repetitions removed."""
    return clean(spoken(t).withColumn("confidence", F.lit(None).cast("double")), "en")


def flagged(rows: DataFrame, language: str, sensitivity: str = "medium") -> DataFrame:
    """Segments (project_id, idx, start, end, text, confidence) with `flag`: whether any of the five detectors, all of which see
    the rows as they are, takes one for a hallucination."""
    limits = fixed.SENSITIVITY[sensitivity]
    timed = ordered.time_flags(rows, ["project_id"], ["idx"], limits["max_segment_duration"], limits["max_overlap_ratio"], "_time")
    timed = blocks.repeated(timed, ["project_id"], "idx", tx.comparable(F.col("text")), ordered.char_similarity, limits["repetition_ratio"], limits["min_repetition_count"], "_run")
    text = F.col("text")
    cjk = language in ("zh", "yue", "wuu", "ja", "ko")
    any_of = F.col("_run") | F.col("_time") | tx.template_phrase(text) | tx.language_switch(text, cjk) | tx.low_confidence(text, F.col("confidence"), limits["min_confidence"])
    return timed.withColumn("flag", F.coalesce(any_of, F.lit(False))).drop("_run", "_time")


def clean(rows: DataFrame, language: str) -> DataFrame:
    """The clean-up pipeline: detectors, then numbers (Chinese only), then fillers; segments left without text go."""
    chinese = language in ("zh", "yue", "wuu", "min_nan", "gan", "hakka", "xiang")
    kept = flagged(rows, language).filter(~F.col("flag")).drop("flag")
    text = tx.numbers_rewritten(F.col("text")) if chinese else F.col("text")
    return kept.withColumn("text", tx.filtered(text, chinese)).filter("trim(text) <> ''")


@query()
def compared_transcripts(t):
    turns = segments(t).groupBy("project_id").agg(F.min_by("text", "idx").alias("a"), F.max_by("text", "idx").alias("b"))
    return evaluation.compare_transcripts(turns, "a", "b", False).select("project_id", "winner", F.round("score_diff", 9).alias("score_diff"))


@query()
def summary_scores(t):
    """Each meeting's first turn, scored as a summary against what the whole transcript says of quantities and tasks."""
    rows = segments(t).groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n").alias("all"), F.min_by("text", "idx").alias("first"))
    none = F.array().cast("array<string>")
    made = F.struct(F.col("first").alias("topic"), none.alias("conclusions"), F.array().cast("array<struct<task:string>>").alias("action_items"), F.array().cast("array<struct<topic:string,summary:string>>").alias("discussion"), none.alias("key_data"))
    scored = evaluation.summary_scores(rows.select("project_id", made.alias("summary"), evaluation.automatic_reference(F.col("all")).alias("reference")))
    return scored.select("project_id", "topic_coverage", "action_item_recall", "key_data_recall", "structural_score", F.round("overall_score", 9).alias("overall_score"))


_LANGUAGES = "CASE event_id % 3 WHEN 0 THEN 'zh' WHEN 1 THEN 'en' ELSE 'de' END"


@query(f"""SELECT event_id, CASE WHEN l = 'zh' AND m >= 3 THEN 'qwen3' WHEN l <> 'zh' AND m >= 1 THEN 'whisper' WHEN l = 'zh' AND m >= 2 THEN 'paraformer' WHEN l = 'zh' AND b THEN 'alibaba-asr' WHEN a THEN 'openai-whisper' WHEN b THEN 'alibaba-asr' ELSE 'whisper' END AS engine,
    CASE WHEN l = 'zh' AND m >= 6 THEN 'qwen3-asr-1.7B' WHEN l = 'zh' AND m >= 3 THEN 'qwen3-asr-0.6B' WHEN l <> 'zh' AND m >= 6 THEN 'large-v3' WHEN l <> 'zh' AND m >= 4 THEN 'medium' WHEN l <> 'zh' AND m >= 2 THEN 'small' WHEN l <> 'zh' AND m >= 1 THEN 'base'
      WHEN l = 'zh' AND m >= 2 THEN 'paraformer-large' WHEN l = 'zh' AND b THEN 'paraformer-v2' WHEN a THEN 'whisper-1' WHEN b THEN 'paraformer-v2' ELSE 'tiny' END AS model
    FROM (SELECT event_id, {_LANGUAGES} AS l, value / 10 AS m, event_id % 5 = 0 AS a, event_id % 7 = 0 AS b FROM events)""")  # fmt: skip
def recommended_engines(t):
    i = F.col("event_id")
    got = evaluation.recommended_engine(F.when(i % 3 == 0, "zh").when(i % 3 == 1, "en").otherwise("de"), F.col("value") / 10, i % 5 == 0, i % 7 == 0)
    return t("events").select("event_id", got.alias("e")).select("event_id", "e.engine", "e.model")


@query(r"SELECT doc_id, greatest(8000, CAST(ceil(length(text) * 1.8) AS BIGINT)) AS budget FROM documents")
def token_budgets(t):
    return t("documents").select("doc_id", tx.token_budget(F.col("text")).alias("budget"))


@query("SELECT c_custkey, CAST(list_sum(list_transform(string_split(c_name, ''), lambda c: ascii(c))) % 8 AS INT) AS colour FROM customer")
def speaker_colours(t):
    return t("customer").select("c_custkey", tx.colour_index(F.col("c_name")).alias("colour"))


@query("SELECT event_id, '会议 ' || strftime(ts, '%m-%d') || ' 周' || substr('日一二三四五六', CAST(dayofweek(ts) AS INT) + 1, 1) || strftime(ts, ' %H:%M') AS name FROM events")
def meeting_names(t):
    return t("events").select("event_id", tx.meeting_name(F.col("ts")).alias("name"))


@query(r"SELECT doc_id, greatest(36.0, greatest(1, ceil((w * 12 + (length(text) - w) * 12 * CAST(0.55 AS DOUBLE)) / CAST(180 AS DOUBLE))) * 16.8 + 16) AS height FROM (SELECT doc_id, text, length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]', '', 'g')) AS w FROM documents)")
def node_heights(t):
    return t("documents").select("doc_id", tx.node_height(F.col("text"), 12, 180, 16, 1.4, 36).cast("double").alias("height"))


@query(r"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[\x22\x27。.，,\n]', '', 'g'), '^\s+|\s+$', '', 'g') AS title, substr(text, 1, 500) AS excerpt FROM conversations")
def clean_titles(t):
    """Turns as a model's titles, cleaned, and the part of a transcript that a title is asked for."""
    return t("conversations").select("conv_id", "turn", tx.clean_title(F.col("text")).alias("title"), F.substring("text", 1, 500).alias("excerpt"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fenced_answers(t):
    answer = F.concat(F.lit("Here it is:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))
    return t("events").select("event_id", F.get_json_object(tx.fenced_json(answer), "$.k").cast("long").alias("k"))


@query("SELECT event_id, event_type || '-' || event_id AS content FROM events")
def streamed_completions(t):
    """Bodies of a stream of two pieces, a malformed line between them and another one after its end."""
    line = lambda c: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(c.alias("content")).alias("delta"))).alias("choices"))), F.lit("\n"))
    body = F.concat(line(F.col("event_type")), F.lit("data: {broken\n: ping\n"), line(F.concat(F.lit("-"), F.col("event_id").cast("string"))), F.lit("data: [DONE]\n"), line(F.lit("late")))
    return t("events").select("event_id", tx.completion(body).alias("content"))


# --- voiceprints ----------------------------------------------------------------------------------------------------


@query("SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding[:32] AS DOUBLE[]), CAST(b.embedding[:32] AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = 0")
def shorter_cosine(t):
    v = vectors.doubles(F.col("embedding"))
    first = t("embeddings").filter("vec_id = 0").select(F.slice(v, 1, 32).alias("short"))  # one row
    return t("embeddings").join(F.broadcast(first), F.lit(True)).select("vec_id", F.round(vectors.cosine_shorter(v, F.col("short")), 6).alias("cosine"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / len(embedding)), 9) AS rms FROM embeddings")
def vector_rms(t):
    v = vectors.doubles(F.col("embedding"))
    return t("embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x) / F.size(v)), 9).alias("rms"))


@query("SELECT e.vec_id, e.label, round(list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), c.m), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(c.m, lambda x: x * x))), 6) AS along FROM embeddings e JOIN (SELECT label, list(m ORDER BY p) AS m FROM (SELECT label, p, avg(x) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS p, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, p) GROUP BY label) c ON e.label = c.label")
def backfilled_centroids(t):
    """Each label's centroid, back at all of its rows."""
    mean = vectors.centroids(t("embeddings"), ["label"], "embedding").select("label", "centroid")
    rows = t("embeddings").join(mean, "label")
    return rows.select("vec_id", "label", F.round(vectors.dot(vectors.doubles(F.col("embedding")), F.col("centroid")), 6).alias("along"))


def _voices(t) -> tuple[DataFrame, DataFrame]:
    """Vectors of a batch are segments; the first of each label is a voiceprint, those of even labels never learned."""
    v = t("embeddings").filter("label is not null").select("vec_id", "label", vectors.doubles(F.col("embedding")).alias("v"))
    known = v.groupBy("label").agg(F.min("vec_id").alias("lid"), F.min_by("v", "vec_id").alias("lvec"))
    library = known.select("lid", F.concat(F.lit("speaker "), "label").alias("name"), "lvec", F.when(F.col("label") % 2 == 0, 0).otherwise(3).alias("n"))
    return v.select(F.floor(F.col("vec_id") / 256).alias("batch"), F.col("vec_id").alias("qid"), F.col("v").alias("qvec")), library


@query()
def enrolled_voiceprints(t):
    queries, library = _voices(t)
    return vectors.match_or_enrol(queries, library, 0.55)


@query()
def learned_voiceprints(t):
    queries, library = _voices(t)
    best = vectors.best_match(queries.select("qid", "qvec"), library.filter("n > 0").select("lid", "lvec"), 0.55).filter("matched")
    got = vectors.learned_voiceprints(best.select("qid", "lid"), queries, library)
    return got.select("lid", "n", F.round(vectors.norm(F.col("lvec")), 6).alias("norm"))


@query()
def spectral_speakers(t):
    rows = t("embeddings").select(F.floor(F.col("vec_id") / 64).alias("recording"), "vec_id", "embedding")
    return vectors.spectral_speakers(rows, ["recording"], "vec_id", "embedding")


# --- recordings and post-processing ----------------------------------------------------------------------------------


@query("""SELECT event_type, CAST(k // 500 AS BIGINT) AS block, count(*) AS n, CAST(sum(CAST(round(value) AS BIGINT) % 100 - 50) AS BIGINT) AS total
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k FROM events) GROUP BY ALL""")
def recording_blocks(t):
    """Each event type's values as a recording: written as WAV files by tasks, and read back in blocks of half a second."""
    rows = t("events").select("event_type", "event_id", (F.round("value").cast("long") % 100 - 50).alias("x"))
    folder = new_path(rows.sparkSession, "recordings")
    saved = rows.groupBy("event_type").applyInPandas(wav.saver(folder, "event_type", "event_id", "x", 1000, 32768), "path string, samples long")
    saved.write.format("noop").mode("overwrite").save()
    wav.register(rows.sparkSession)
    name = F.regexp_extract("path", r"([^/]+)\.wav$", 1)
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double") * 32768)
    read = rows.sparkSession.read.format("wav").option("blockSeconds", 0.5).load(folder)
    return read.select(name.alias("event_type"), "block", F.size("samples").cast("long").alias("n"), F.round(total).cast("long").alias("total"))


@query(_FOLD.format(marked=sql_any("lower(text)", fixed.MARKERS_EN), split="s.m AND f.n >= 2").replace("SELECT conv_id AS project_id, turn AS idx, CAST(paragraph AS BIGINT) AS paragraph FROM f", r"""
    SELECT f.conv_id AS project_id, f.turn AS idx, CAST(paragraph AS BIGINT) AS paragraph, contains(c.text, '|') AS failed, CASE WHEN regexp_matches(x, '[.!?。！？]$') THEN x ELSE x || '.' END AS text
      FROM f JOIN (SELECT conv_id, turn, text, CASE WHEN contains(text, '|') THEN text ELSE regexp_replace(text, ' +', ' ', 'g') END AS x FROM conversations) c ON f.conv_id = c.conv_id AND f.turn = c.turn"""))
def post_processed(t):
    """Turns after correction, paragraphs and punctuation; the correction fails on texts with a bar, which keep theirs."""
    todo = [
        steps.Step("correction", text=_single_spaces),
        steps.Step("segmentation", rows=lambda df: blocks.paragraphs(df, ["project_id"], ["idx"], F.coalesce(tx.any_of(F.lower("text"), fixed.MARKERS_EN), F.lit(False)), "semantic")),
        steps.Step("punctuation", text=lambda s: s if s[-1:] in ".!?。！？" and s else s + "."),
        steps.Step("hallucination", rows=lambda df: df.filter("idx < 0")),  # off: all rows would go
    ]
    done = steps.post_processed(segments(t), todo, {"hallucination": False})
    return done.select("project_id", "idx", "paragraph", (F.size("errors") > 0).alias("failed"), "text")


def _single_spaces(text: str) -> str:
    if "|" in text:
        raise ValueError("a table isn't speech")
    return " ".join(x for k, x in enumerate(text.split(" ")) if x or k in (0, text.count(" ")))


# --- changes of the store -------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT 0, 1.5")
def insert_project(t):
    new = t("region").limit(1).select(F.lit(0).cast("long").alias("o_orderkey"), F.lit(1.5).alias("o_totalprice"))
    return t("orders").select("o_orderkey", "o_totalprice").unionByName(new)


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def delete_folder(t):
    """A region goes with all its nations and customers; what refers to them goes, too."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = t("region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id")).unionByName(t("nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent_id")))
    left = relational.delete_subtree(nodes, "r1", {"customers": (t("customer").withColumn("node", key("n", "c_nationkey")), "node")})
    return left["customers"].select("c_custkey")


@query("SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN CAST(c_nationkey AS VARCHAR) END AS nation FROM customer")
def delete_voiceprint(t):
    gone = t("nation").filter("n_nationkey = 3").select(F.col("n_nationkey").alias("id"))
    return relational.unlinked(t("customer").select("c_custkey", F.col("c_nationkey").alias("nation")), "nation", gone).withColumn("nation", F.col("nation").cast("string"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_orderkey = 1 AND l_linenumber = 1)")
def delete_attachment(t):
    gone = t("lineitem").filter("l_orderkey = 1 and l_linenumber = 1").select("l_orderkey", "l_linenumber")
    return t("lineitem").select("l_orderkey", "l_linenumber").join(gone, ["l_orderkey", "l_linenumber"], "left_anti")


@query("SELECT vec_id, label FROM embeddings WHERE label IS DISTINCT FROM 1 UNION ALL SELECT vec_id + 1000000000, label FROM embeddings WHERE label = 1")
def reindexed_vectors(t):
    """A project's vectors are deleted, and its new ones appended."""
    rows = t("embeddings").select("vec_id", "label")
    kept = rows.filter(~F.col("label").eqNullSafe(F.lit(1)))
    return kept.unionByName(rows.filter("label = 1").withColumn("vec_id", F.col("vec_id") + 1_000_000_000))


@query(f"SELECT project_id, idx, start FROM {_SEGMENTS} s WHERE s.start < 8 OR NOT EXISTS (SELECT 1 FROM {_SEGMENTS} n WHERE n.project_id = s.project_id AND n.idx = 2) UNION ALL SELECT project_id, idx + 100, start FROM {_SEGMENTS} WHERE idx >= 2 AND project_id IN (SELECT project_id FROM {_SEGMENTS} WHERE idx = 2)")
def kept_prefix(t):
    rows = spoken(t).select("project_id", "idx", "start")
    having = rows.filter("idx = 2").select("project_id")
    new = rows.filter("idx >= 2").join(having, "project_id", "left_semi").withColumn("idx", F.col("idx") + 100)
    return ordered.keep_prefix(rows, new, ["project_id"])


@query(f'SELECT project_id, idx // 3 AS paragraph, min(start) AS start, max("end") AS "end" FROM {_SEGMENTS} GROUP BY ALL')
def paragraph_bounds(t):
    rows = spoken(t).withColumn("paragraph", F.floor(F.col("idx") / 3))
    return ordered.paragraph_bounds(rows, ["project_id"], "idx", "paragraph")


@query(f"SELECT project_id, speaker, min(start) AS start, max(\"end\") AS \"end\" FROM (SELECT *, sum(c) OVER (PARTITION BY project_id ORDER BY start) AS g FROM (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER (PARTITION BY project_id ORDER BY start) THEN 1 ELSE 0 END AS c FROM {_SEGMENTS} WHERE speaker IS NOT NULL)) GROUP BY project_id, speaker, g")
def merged_windows(t):
    return ordered.merge_windows(spoken(t), ["project_id"], "speaker").select("project_id", "speaker", "start", "end")


@query(f"SELECT project_id, idx, text, role FROM (SELECT s.*, row_number() OVER (PARTITION BY project_id ORDER BY idx) AS r FROM {_SEGMENTS} s) LEFT JOIN (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE turn % 2 = 0) o ON project_id = conv_id AND o.r = r".replace("ON project_id = conv_id AND o.r = r", "ON project_id = conv_id AND o.r = s2.r").replace(f"FROM {_SEGMENTS} s) LEFT", f"FROM {_SEGMENTS} s) s2 LEFT"))
def zipped_segments(t):
    others = segments(t).filter("idx % 2 = 0").select("project_id", "idx", F.col("speaker").alias("role"))
    return relational.zipped(spoken(t), others, ["project_id"], "idx", "role").select("project_id", "idx", "text", "role")


@query("SELECT n_nationkey, n_regionkey = 0 AS is_folder FROM nation ORDER BY is_folder DESC, n_nationkey")
def folders_first(t):
    return t("nation").select("n_nationkey", (F.col("n_regionkey") == 0).alias("is_folder")).orderBy(F.desc("is_folder"), "n_nationkey")


@query("SELECT doc_id FROM documents WHERE source IS DISTINCT FROM 'src0'")
def projects_only(t):
    return t("documents").filter(~F.coalesce(F.col("source") == "src0", F.lit(False))).select("doc_id")


@query("SELECT event_type, array_to_string(list_sort(list(DISTINCT user_id)), ' ') AS users FROM events GROUP BY event_type")
def grouped_by_type(t):
    """The users of each type in ascending order, as one text."""
    return relational.listed(t("events").select("event_type", "user_id").distinct(), "event_type", "user_id", "users")


@query("SELECT event_id, 15 + 0.85 * value AS progress, CAST(floor(value / 30) AS BIGINT) AS chunk FROM events")
def job_progress(t):
    return t("events").select("event_id", (15 + 0.85 * F.col("value")).alias("progress"), F.floor(F.col("value") / 30).alias("chunk"))


@query(f"""SELECT s.project_id, count(*) FILTER (own < 0.01) > 0.8 * count(*) OR avg(own) > 2 * any_value(turn) AS split
    FROM (SELECT project_id, CASE WHEN project_id % 4 = 0 OR idx % 3 = 0 THEN 0 ELSE 2 + idx END AS own FROM {_SEGMENTS}) s
      JOIN (SELECT project_id, avg(1 + project_id % 3) AS turn FROM {_SEGMENTS} GROUP BY project_id) r ON s.project_id = r.project_id GROUP BY s.project_id""")
def sentence_split_needed(t):
    """Segments of no duration, or longer and longer ones, against speakers' turns of one to three seconds."""
    own = F.when((F.col("project_id") % 4 == 0) | (F.col("idx") % 3 == 0), 0.0).otherwise(2.0 + F.col("idx"))
    rows = spoken(t).withColumn("end", F.col("start") + own)
    turns = spoken(t).withColumn("end", F.col("start") + 1.0 + F.col("project_id") % 3)
    return ordered.sentence_split_needed(rows, turns, ["project_id"])


_SOUND = "(SELECT event_type, user_id % 10 AS part, list((CAST(round(value) AS BIGINT) % 100 - 50) / 100.0 * CASE WHEN event_id % 200 < 120 THEN 0.001 ELSE 1 END ORDER BY event_id) AS samples FROM events GROUP BY ALL)"


@query(f"""SELECT event_type, part, CAST(k AS DOUBLE) AS window_start, round(rms, 6) AS rms FROM (SELECT event_type, part, k, sqrt(list_avg(list_transform(samples[k * 4 + 1 : k * 4 + 12], lambda x: CAST(x AS DOUBLE) * x))) AS rms
    FROM (SELECT *, unnest(range(0, CAST(floor(len(samples) / 4.0 - 3) AS BIGINT) + 1)) AS k FROM {_SOUND} WHERE len(samples) >= 12)) WHERE rms >= 0.01""")
def voiced_windows(t):
    """Three-second windows of recordings of four samples a second, without the silent ones."""
    x = (F.round("value").cast("long") % 100 - 50) / 100.0 * F.when(F.col("event_id") % 200 < 120, 0.001).otherwise(1.0)
    rows = t("events").select("event_type", (F.col("user_id") % 10).alias("part"), "event_id", x.alias("x"))
    return ordered.voiced_windows(rows, ["event_type", "part"], "event_id", F.col("x"), 4).select("event_type", "part", "window_start", F.round("rms", 6).alias("rms"))


@query("SELECT item_id, CASE WHEN item_id % 3 = 0 AND item_id % 2 = 0 THEN text WHEN item_id % 3 < 2 THEN 'raw: ' || text ELSE '# ' || item_id END AS body FROM benchmark")
def preferred_summaries(t):
    """Edited summaries come before a model's, and these before ones made of parts; an empty edit is none."""
    i = F.col("item_id")
    edited, raw = F.when(i % 3 == 0, F.when(i % 2 == 0, F.col("text")).otherwise("")), F.when(i % 3 < 2, F.concat(F.lit("raw: "), "text"))
    return t("benchmark").select("item_id", exports.preferred(edited, raw, F.concat(F.lit("# "), i.cast("string"))).alias("body"))


_MARKS = r"length(regexp_extract(substr(rest, 1, 201), '(?s)^.*[。！？.!?\n]'))"


@query(rf"""WITH RECURSIVE p AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS piece, text AS rest FROM conversations WHERE text IS NOT NULL UNION ALL
      SELECT conv_id, turn, k + 1, substr(rest, 1, c), substr(rest, c + 1) FROM (SELECT *, CASE WHEN length(rest) <= 200 THEN length(rest) WHEN {_MARKS} > 101 THEN {_MARKS} ELSE 200 END AS c FROM p WHERE length(rest) > 0))
    SELECT conv_id, turn, CAST(k - 1 AS INT) AS pos, piece FROM p WHERE k > 0""")
def transcript_pieces(t):
    """Turns cut for a model: pieces of about two hundred characters that end with a sentence where one ends in their second half."""
    rows = t("conversations").filter("text is not null").select("conv_id", "turn", F.posexplode(tx.transcript_pieces(F.col("text"), 200)).alias("pos", "piece"))
    return rows.filter("piece <> ''")


_ZH = """(SELECT event_id, ['我们开会讨论项目', '预算需要审批', '好好好好的', '嗯嗯那个就是说', '然后然后然后继续'][event_id % 5 + 1] || event_id % 130 || ['个月', '年预算', 'x', '', '9天'][event_id % 7 % 5 + 1] || repeat('对', event_id % 6) || user_id AS text FROM events)"""


def _chinese(t) -> DataFrame:
    """Turns in Chinese, of phrases that an event's numbers choose: repeats, fillers and numbers among them."""
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), k.cast("int") + 1)
    i = F.col("event_id")
    text = F.concat(pick(("我们开会讨论项目", "预算需要审批", "好好好好的", "嗯嗯那个就是说", "然后然后然后继续"), i % 5), (i % 130).cast("string"), pick(("个月", "年预算", "x", "", "9天"), i % 7 % 5), F.repeat(F.lit("对"), (i % 6).cast("int")), F.col("user_id").cast("string"))
    return t("events").select("event_id", text.alias("text"))


def _sql_char(test: str, place: str) -> str:
    at = f"substr(text, CAST({place} AS BIGINT), 1)"
    return {"cjk": f"({at} <> '' AND unicode({at}) BETWEEN 19968 AND 40959)", "digit": f"({at} >= '0' AND {at} <= '9')"}[test]


@query(f"""SELECT event_id, text, len(list_filter(range(2, length(text) + 1), lambda i: {_sql_char('digit', 'i')} AND {_sql_char('cjk', 'i - 1')} AND {_sql_char('cjk', 'i + 1')}))
    + len(list_filter(range(1, length(text) + 1), lambda i: {_sql_char('digit', 'i')} AND NOT (i > 1 AND {_sql_char('digit', 'i - 1')}) AND {_sql_char('cjk', 'i + 1')} AND {_sql_char('cjk', 'i + 2')})) AS issues FROM {_ZH}""")
def number_issues(t):
    """Digits among ideographs, in Chinese turns."""
    return _chinese(t).select("event_id", "text", tx.number_issues_zh(F.col("text")).alias("issues"))


@query()
def chinese_clean_up(t):
    """Chinese turns with repeats merged, fillers removed and numbers rewritten."""
    text = F.col("text")
    return _chinese(t).select("event_id", "text", tx.merge_repeats_zh(text).alias("merged"), tx.filtered(text, True).alias("filtered"), tx.numbers_rewritten(text).alias("rewritten"), F.round(tx.repetition_density_zh(text), 9).alias("repetition"))


@query("SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]{2,}'))), ' '), '') AS numbers FROM documents WHERE text IS NOT NULL")
def distinct_numbers(t):
    return t("documents").filter("text is not null").select("doc_id", F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9]{2,}"), F.lit(0)))), " ").alias("numbers"))


@query(f"SELECT project_id, CAST(idx AS BIGINT) AS seq, CASE WHEN idx = last THEN 'done' ELSE 'token' END AS event, text AS data FROM (SELECT *, max(idx) OVER (PARTITION BY project_id) AS last FROM {_SEGMENTS})")
def event_stream(t):
    last = segments(t).groupBy("project_id").agg(F.max("idx").alias("last"))
    rows = segments(t).join(last, "project_id")
    return rows.select("project_id", F.col("idx").alias("seq"), F.when(F.col("idx") == F.col("last"), "done").otherwise("token").alias("event"), F.col("text").alias("data"))


@query("SELECT event_id, CAST(epoch_us(ts) // 30000000 AS BIGINT) AS tick FROM events")
def persist_ticks(t):
    """The half minute at whose end each event of a stream is persisted."""
    return t("events").select("event_id", F.floor(micros() / 30_000_000).alias("tick"))


@query(f"SELECT conv_id, turn, {sql_any('lower(text)', fixed.MARKERS_ZH)} AS marked FROM conversations")
def topic_markers_zh(t):
    return t("conversations").select("conv_id", "turn", tx.any_of(F.lower("text"), fixed.MARKERS_ZH).alias("marked"))


# --- audio and recognisers ------------------------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(x * 1000) AS BIGINT)) AS a FROM embeddings),
    m AS (SELECT vec_id, list_transform(range(32), lambda i: CAST(trunc((a[2 * i + 1] + a[2 * i + 2]) / 2) AS BIGINT)) AS mono, a FROM s),
    r AS (SELECT vec_id, list_transform(range(16), lambda i: mono[2 * i + 1]) AS r, a FROM m)
    SELECT vec_id, CAST(list_sum(list_transform(range(64), lambda i: CAST(trunc((a[i + 1] + coalesce(r[i + 1], 0)) / 2) AS BIGINT))) AS BIGINT) AS total FROM r""")  # fmt: skip
def mixed_samples(t):
    """Each vector as samples, mixed with itself as stereo at twice the rate. Samples are scaled in the vectors' own precision."""
    scaled = lambda x: x * F.lit(1000).cast("float")
    a = F.transform("embedding", lambda x: F.when(x < 0, -F.floor(F.abs(scaled(x)))).otherwise(F.floor(scaled(x))))
    other = audio.resampled(audio.mono(F.col("a"), 2), 2, 1)
    total = F.aggregate(audio.mixed(F.col("a"), other), F.lit(0).cast("long"), lambda s, x: s + x)
    return t("embeddings").withColumn("a", a).select("vec_id", total.alias("total"))


_ENERGY = """WITH e AS (SELECT vec_id, list_transform(range(21), lambda i: sqrt(list_sum(list_transform(CAST(embedding[3 * i + 1 : 3 * i + 3] AS DOUBLE[]), lambda x: x * x)) / 3)) AS e FROM embeddings),
    h AS (SELECT vec_id, e, list_sort(e)[7] + 0.25 * (list_sort(e)[20] - list_sort(e)[7]) AS least FROM e),
    f AS (SELECT vec_id, unnest(range(21)) AS i, unnest(e) AS x, least FROM h),
    g AS (SELECT vec_id, i, sum(CASE WHEN i - p - 1 >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY i) AS g FROM (SELECT vec_id, i, lag(i) OVER (PARTITION BY vec_id ORDER BY i) AS p FROM f WHERE x > least)),
    r AS (SELECT vec_id, min(i) AS a, CASE WHEN 21 - max(i) - 1 < 3 THEN 21 ELSE max(i) + 1 END AS b FROM g GROUP BY vec_id, g)
    SELECT vec_id, CAST(round(a * 0.03, 6) AS DOUBLE) AS start, CAST(round(CASE WHEN b = 21 THEN 0.64 ELSE least(b * 0.03, 0.64) END, 6) AS DOUBLE) AS "end" FROM r WHERE b - a >= 2
    UNION ALL SELECT vec_id, 0.0, 0.64 FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM r WHERE b - a >= 2)"""


@query(_ENERGY)
def speech_regions(t):
    """Each vector as a stretch of 0.64 seconds at 100 samples a second."""
    rows = t("embeddings").select("vec_id", F.lit(0.0).alias("start"), F.lit(0.64).alias("end"), vectors.doubles(F.col("embedding")).alias("samples"))
    return audio.speech_regions(rows, ["vec_id"], 100, speech_ms=60, silence_ms=90).select("vec_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(f"""SELECT vec_id, start, "end" FROM ({_ENERGY}) WHERE vec_id % 3 = 0 UNION ALL SELECT vec_id, 0.0, CASE WHEN vec_id % 3 = 1 THEN 0.3 END FROM embeddings WHERE vec_id % 3 > 0""")
def segment_parts(t):
    """Segments of more than half a second are cut to their regions of speech; shorter ones, and ones without an end, stay."""
    end = F.when(F.col("vec_id") % 3 == 0, 0.64).when(F.col("vec_id") % 3 == 1, 0.3)
    rows = t("embeddings").select("vec_id", F.lit(0.0).alias("start"), end.alias("end"), vectors.doubles(F.col("embedding")).alias("samples"))
    return audio.segment_parts(rows, ["vec_id"], 100, most=0.5, speech_ms=60, silence_ms=90).select("vec_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query()
def diarised_segments(t):
    parts = t("embeddings").select(F.floor(F.col("vec_id") / 64).alias("recording"), F.floor(F.col("vec_id") / 4).alias("segment"), F.col("vec_id").alias("part"), "embedding")
    return audio.diarised(parts, "recording", "segment")


@query("SELECT event_id, CAST(unnest([0, 1]) AS INT) AS idx, round(unnest([event_id * 10, event_id * 10 + 5]) / 1000.0, 3) AS start, unnest([event_type, 'end']) AS text FROM events")
def recogniser_segments(t):
    sent = lambda a, text: F.struct(text.alias("text"), a.alias("start"), (a + 5).alias("end"))
    at = F.col("event_id") * 10
    body = F.to_json(F.array(F.struct(F.array(sent(at, F.concat(F.lit(" "), "event_type")), sent(at + 5, F.lit("end "))).alias("sentence_info"))))
    rows = t("events").select("event_id", body.alias("body"))
    return audio.sentence_segments(rows, "event_id", "body").select("event_id", "idx", "start", "text")


@query("""SELECT event_id, f AS format, CAST(i AS INT) AS idx, start, "end", text, speaker, confidence FROM (
      SELECT event_id, 'sentences' AS f, 0 AS i, round(event_id / 1000.0, 3) AS start, round((event_id + 5) / 1000.0, 3) AS "end", event_type AS text, NULL AS speaker, CAST(NULL AS DOUBLE) AS confidence FROM events WHERE event_id % 5 = 0
      UNION ALL SELECT event_id, 'sentences', 1, 0, 0, 'later', NULL, NULL FROM events WHERE event_id % 5 = 0
      UNION ALL SELECT event_id, 'verbose', 0, round(value, 3), round(value + 1, 3), event_type, NULL, -0.25 FROM events WHERE event_id % 5 = 1
      UNION ALL SELECT event_id, 'output', 0, round(event_id / 1000.0, 3), 0, event_type, CASE WHEN event_id % 2 = 0 THEN 'Speaker_' || user_id END, NULL FROM events WHERE event_id % 5 = 2
      UNION ALL SELECT event_id, 'chunks', 0, CASE WHEN event_id % 2 = 0 THEN round(value, 3) ELSE 0 END, CASE WHEN event_id % 2 = 0 THEN round(value + 2, 3) ELSE 0 END, event_type, NULL, NULL FROM events WHERE event_id % 5 = 3)""")
def recognised_segments(t):
    """Answers of four recognisers and some that are none, in one table; of the chunked ones, the odd have a text only."""
    s, i, x, name = (lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])), F.col("event_id"), F.col("value"), F.concat(F.lit(" "), "event_type")
    sentences = F.concat(F.lit("["), F.to_json(s(sentence_info=F.array(s(text=name, start=i, end=i + 5)))), F.lit(',{"text":"later"},{"text":" "}]'))
    verbose = F.to_json(s(text=name, segments=F.array(s(start=x, end=x + 1, text=name, avg_logprob=F.lit(-0.25)))))
    output = F.to_json(s(output=s(sentence=F.array(s(begin_time=i, text=name, speaker_id=F.when(i % 2 == 0, F.col("user_id")))))))
    chunks = F.when(i % 2 == 0, F.to_json(s(text=name, chunks=F.array(s(timestamp=F.array(x, x + 2), text=name), s(timestamp=F.array(x, x), text=F.lit(" ")))))).otherwise(F.to_json(s(text=name, chunks=F.array())))
    body = F.when(i % 5 == 0, sentences).when(i % 5 == 1, verbose).when(i % 5 == 2, output).when(i % 5 == 3, chunks).otherwise("{not JSON")
    return audio.recognised_segments(t("events").select("event_id", body.alias("body")), "event_id", "body")


@query("SELECT event_id, CAST(event_id % 4 * 30 AS DOUBLE) AS start, CAST(least(event_id % 4 * 30 + 30, 100) AS DOUBLE) AS \"end\" FROM events")
def chunked_segments(t):
    rows = t("events").select("event_id", (F.col("event_id") % 4).alias("chunk"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"))
    return audio.chunk_segments(rows, "chunk", 30, F.lit(100.0)).select("event_id", "start", "end")


@query(f'''WITH RECURSIVE s AS (SELECT project_id, idx, start * 20 AS a, start * 20 + 60 AS b, row_number() OVER (PARTITION BY project_id ORDER BY idx) AS r FROM {_SEGMENTS}),
    f AS (SELECT project_id, idx, r, a AS begin, 0 AS w FROM s WHERE r = 1 UNION ALL
      SELECT s.project_id, s.idx, s.r, CASE WHEN s.b - f.begin > 240 THEN s.a ELSE f.begin END, f.w + CASE WHEN s.b - f.begin > 240 THEN 1 ELSE 0 END FROM f JOIN s ON s.project_id = f.project_id AND s.r = f.r + 1)
    SELECT f.project_id, CAST(w AS BIGINT) AS w, CAST(greatest(min(a) - 5, 0) AS DOUBLE) AS start, CAST(least(arg_max(b, a) + 5, 10000) AS DOUBLE) AS "end" FROM f JOIN s ON f.project_id = s.project_id AND f.r = s.r GROUP BY f.project_id, w''')
def aligner_windows(t):
    rows = spoken(t).select("project_id", "idx", (F.col("start") * 20).alias("start"), (F.col("start") * 20 + 60).alias("end"))
    return ordered.window_bounds(blocks.recording_windows(rows, ["project_id"], ["idx"], name="w"), ["project_id"], "w", F.lit(10_000.0))


_LCS = "list_max(list_transform(range(1, 21), lambda n: CASE WHEN len(list_filter(range(1, length({a}) - n + 2), lambda i: contains({b}, substr({a}, i, n)))) > 0 THEN n ELSE 0 END))"


@query(rf"""WITH i AS (SELECT project_id, lower(arg_max(text, idx)) AS a FROM {_SEGMENTS} GROUP BY project_id),
    k AS (SELECT project_id, a, list_distinct(list_concat(regexp_extract_all(a, '{fixed.PHRASE_ZH}'), regexp_extract_all(a, '[a-z]{{4,}}'))) AS words FROM i),
    s AS (SELECT k.project_id, idx, start, coalesce(list_sum(list_transform(list_filter(words, lambda w: contains(lower(text), w)), lambda w: length(w))), 0) + 2 * {_LCS.format(a="k.a", b="lower(text)")} AS score
      FROM k JOIN {_SEGMENTS} x ON k.project_id = x.project_id)
    SELECT i.project_id, 0 AS item, start FROM i LEFT JOIN (SELECT project_id, start FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY score DESC, idx) = 1) b ON i.project_id = b.project_id""")  # fmt: skip
def located_items(t):
    """Where in its meeting each last turn was said."""
    rows = spoken(t)
    items = rows.groupBy("project_id").agg(F.max_by("text", "idx").alias("text")).withColumn("item", F.lit(0))
    return intervals.locate(items, rows.select("project_id", "idx", "start", "text"), "project_id").select("project_id", "item", "start")


@query("SELECT conv_id AS project_id, CAST(sum(length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def map_reduced(t):
    """Occurrences of a word, counted turn by turn and added up."""
    rows = segments(t).groupBy("project_id").agg(F.collect_list("text").alias("texts"))
    count = lambda x: ((F.length(x) - F.length(F.replace(x, F.lit("the"), F.lit("")))) / 3).cast("long")
    got = audio.map_reduce(rows, "project_id", F.col("texts"), count, lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x))
    return got.withColumnRenamed("result", "n")


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT o_orderkey, 'legacy' FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
def imported_projects(t):
    legacy = t("orders").select(F.col("o_orderkey").alias("c_custkey"), F.lit("legacy").alias("c_name"))
    return store.imported(t("customer").select("c_custkey", "c_name"), legacy, "c_custkey")


@query("SELECT user_id AS project_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM events e JOIN customer ON user_id = c_custkey WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 2 <> 0")
def open_action_items(t):
    """Items whose done is true are left out; those without it stay."""
    k = F.get_json_object("props", "$.k").cast("long")
    lists = t("events").select(F.col("user_id").alias("project_id"), F.to_json(F.array(F.struct(k.alias("k"), F.when(k % 2 == 0, True).alias("done")))).alias("action_items"))
    projects = t("customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("title"))
    return relational.action_items(lists, projects, "array<struct<k:bigint,done:boolean>>", include_done=False).select("project_id", "k")
