"""A model's summary of a meeting: parsed, written as Markdown, and laid out as a tree of topic, branches and leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed
from ..functions import text as tx

ANSWER = """topic string, conclusions array<string>, decisions array<struct<decision:string,made_by:string,reasoning:string>>,
    action_items array<struct<assignee:string,task:string,deadline:string,priority:string,status:string>>,
    discussion array<struct<topic:string,summary:string,participants:array<string>,key_points:array<string>>>,
    technical_details array<struct<category:string,details:string>>, next_steps array<string>, key_data array<string>, participants array<string>"""


def _or(value: Column, default: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", default).otherwise(value)


def parsed(answer: Column) -> Column:
    """The structured summary of a model's answer (in a fence or not), with defaults for what it lacks, and its Markdown as `raw`; an
    answer that isn't JSON is all raw."""
    body = tx.fenced_json(answer)
    s = F.from_json(body, ANSWER)
    each = lambda c, f: F.coalesce(F.transform(s[c], f), F.transform(F.filter(s[c], lambda x: F.lit(False)), f), F.array())
    texts = {c: F.coalesce(s[c], F.array().cast("array<string>")) for c in ("conclusions", "next_steps", "key_data", "participants")}
    plain = lambda x, *names: F.struct(*[_or(x[n], "").alias(n) for n in names])
    none = F.array().cast("array<string>")
    columns = {
        "topic": _or(s["topic"], ""),
        "conclusions": texts["conclusions"],
        "decisions": each("decisions", lambda x: plain(x, "decision", "made_by", "reasoning")),
        "action_items": each("action_items", lambda x: F.struct(_or(x["assignee"], "").alias("assignee"), _or(x["task"], "").alias("task"), F.when(x["deadline"] != "", x["deadline"]).alias("deadline"), _or(x["priority"], "medium").alias("priority"), _or(x["status"], "not_started").alias("status"), F.lit(False).alias("done"))),
        "discussion": each("discussion", lambda x: F.struct(_or(x["topic"], "").alias("topic"), _or(x["summary"], "").alias("summary"), F.coalesce(x["participants"], none).alias("participants"), F.coalesce(x["key_points"], none).alias("key_points"))),
        "technical_details": each("technical_details", lambda x: plain(x, "category", "details")),
        "next_steps": texts["next_steps"],
        "key_data": texts["key_data"],
        "participants": texts["participants"],
    }
    valid = F.try_parse_json(body).isNotNull()
    return F.struct(*[c.alias(n) for n, c in columns.items()], F.when(valid, _markdown(columns)).otherwise(answer).alias("raw"))


def _listed(title: str, lines: Column) -> Column:
    """A headed list's lines, with blank ones after the head and at the end; none for an empty list."""
    return F.when(F.size(lines) > 0, F.concat(F.array(F.lit(f"## {title}"), F.lit("")), lines, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))


def _markdown(s: dict[str, Column]) -> Column:
    after = lambda x, a, b="": F.when(F.coalesce(x, F.lit("")) == "", "").otherwise(F.concat(F.lit(a), x, F.lit(b)))
    dash = lambda x: F.concat(F.lit("- "), x)
    t, none = fixed.SUMMARY_TITLES, F.array().cast("array<string>")
    level = lambda p: F.when(p == "high", " 🔴").when(p == "low", " 🟢").otherwise("")

    def talk(d):
        people = F.when(F.size(d["participants"]) > 0, F.array(F.concat(F.lit("**参与者:** "), F.array_join(d["participants"], "、")), F.lit(""))).otherwise(none)
        points = F.when(F.size(d["key_points"]) > 0, F.concat(F.array(F.lit("**关键要点:**"), F.lit("")), F.transform(d["key_points"], dash), F.array(F.lit("")))).otherwise(none)
        return F.concat(F.array(F.concat(F.lit("### "), d["topic"]), F.lit("")), people, F.array(d["summary"], F.lit("")), points)

    talks = F.flatten(F.transform(s["discussion"], talk))
    lines = F.concat(
        F.when(s["topic"] != "", F.array(F.concat(F.lit("# "), s["topic"]), F.lit(""))).otherwise(none),
        _listed(t["conclusions"], F.transform(s["conclusions"], dash)),
        _listed(t["decisions"], F.transform(s["decisions"], lambda d: F.concat(F.lit("- **"), d["decision"], F.lit("**"), after(d["made_by"], " (", ")"), after(d["reasoning"], " — ")))),
        _listed(t["action_items"], F.transform(s["action_items"], lambda i: F.concat(F.lit("- [ ] "), i["task"], level(i["priority"]), after(i["assignee"], " (@", ")"), after(i["deadline"], " [截止: ", "]")))),
        F.when(F.size(talks) > 0, F.concat(F.array(F.lit(f"## {t['discussion']}"), F.lit("")), talks)).otherwise(none),
        _listed(t["technical_details"], F.transform(s["technical_details"], lambda d: F.concat(F.lit("- **"), d["category"], F.lit("**: "), d["details"]))),
        _listed(t["next_steps"], F.transform(s["next_steps"], dash)),
        _listed(t["key_data"], F.transform(s["key_data"], dash)),
        F.when(F.size(s["participants"]) > 0, F.array(F.lit(f"## {t['participants']}"), F.lit(""), F.array_join(F.transform(s["participants"], lambda p: F.concat(F.lit("@"), p)), "、"), F.lit(""))).otherwise(none),
    )
    return F.array_join(lines, "\n")


def tree(rows: DataFrame, key: str, summary: str = "summary") -> DataFrame:
    """Nodes (key, branch, place, id, parent, label, font) of parsed summaries: the topic is the root (branch -1), each field that has
    entries a branch (place -1) in a fixed order, each entry a leaf."""
    s = lambda c: F.col(f"{summary}.{c}")
    tail = lambda x, a, b: F.when(F.coalesce(x, F.lit("")) == "", "").otherwise(F.concat(F.lit(a), x, F.lit(b)))
    pair = lambda a, b: F.concat(a, F.lit(": "), b)
    labels = {
        "conclusions": lambda x: x,
        "action_items": lambda x: F.concat(pair(x["assignee"], x["task"]), tail(x["deadline"], " (", ")")),
        "decisions": lambda x: F.concat(x["decision"], tail(x["made_by"], " (", ")")),
        "discussion": lambda x: pair(x["topic"], x["summary"]),
        "technical_details": lambda x: pair(x["category"], x["details"]),
        "next_steps": lambda x: x,
    }
    leaf = lambda k, name, f: lambda x, i: F.struct(F.lit(k).alias("branch"), i.cast("int").alias("place"), F.concat(F.lit(f"{fixed.TREE_IDS[name][1]}-"), i.cast("string")).alias("id"), F.lit(fixed.TREE_IDS[name][0]).alias("parent"), f(x).alias("label"), F.lit(fixed.SUMMARY_TITLES[name]).alias("_title"))
    every = F.concat(*[F.transform(s(name), leaf(k, name, f)) for k, (name, f) in enumerate(labels.items())])
    leaves = rows.select(key, F.explode(every).alias("n")).select(key, "n.*")
    branches = leaves.select(key, "branch", F.lit(-1).alias("place"), F.col("parent").alias("id"), F.lit("root").alias("parent"), F.col("_title").alias("label"), F.lit(13).alias("font")).distinct()
    roots = rows.select(key, F.lit(-1).alias("branch"), F.lit(-1).alias("place"), F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent"), s("topic").alias("label"), F.lit(14).alias("font"))
    return roots.unionByName(branches).unionByName(leaves.drop("_title").withColumn("font", F.lit(12)))


WIDTH, LEAST, GAP, LINE, PAD_X, PAD_Y = 240.0, 40.0, 16.0, 1.4, 24.0, 12.0
COLUMNS = (0.0, 360.0, 680.0)  # of the root, the branches and the leaves


def layout(nodes: DataFrame, key: str) -> DataFrame:
    """nodes of tree() with x and y: leaves below each other, branches and root half way between their first and last child."""
    lines = lambda font: F.greatest(F.lit(1), F.ceil(_width(font) / (WIDTH - PAD_X)))
    nodes = nodes.withColumn("_h", F.greatest(F.lit(LEAST), lines(F.col("font")) * F.col("font") * LINE + PAD_Y))
    before = lambda h, *by: F.coalesce(F.sum(h + GAP).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    leaves = nodes.filter("place >= 0").withColumn("_off", before(F.col("_h"), key, "branch", "place"))
    own = nodes.filter("branch >= 0 and place < 0").select(key, "branch", F.col("_h").alias("_self"))
    branches = leaves.groupBy(key, "branch").agg(F.max("_off").alias("_last"), F.max(F.col("_off") + F.col("_h")).alias("_sum")).join(own, [key, "branch"])
    branches = branches.withColumn("_top", before(F.greatest("_self", "_sum"), key, "branch")).withColumn("_mid", F.col("_top") + F.col("_last") / 2).select(key, "branch", "_top", "_mid")
    ends = branches.groupBy(key).agg(((F.min_by("_mid", "branch") + F.max_by("_mid", "branch")) / 2).alias("_root"))
    placed = nodes.join(branches, [key, "branch"], "left").join(ends, key, "left").join(leaves.select(key, "branch", "place", "_off"), [key, "branch", "place"], "left")
    y = F.when(F.col("branch") < 0, F.coalesce("_root", F.lit(0.0))).when(F.col("place") < 0, F.col("_mid")).otherwise(F.col("_top") + F.col("_off"))
    x = F.when(F.col("branch") < 0, COLUMNS[0]).when(F.col("place") < 0, COLUMNS[1]).otherwise(COLUMNS[2])
    return placed.select(key, "branch", "place", "id", "parent", "label", "font", x.alias("x"), y.alias("y"))


def _width(font: Column) -> Column:
    label = F.coalesce("label", F.lit(""))
    wide = F.regexp_count(label, F.lit(f"[{fixed.WIDE}]"))
    return wide * font + (F.length(label) - wide) * (font * 0.55)
