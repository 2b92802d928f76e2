"""robots.txt: groups of rules from text, and which pages they allow."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.url import agent_token
from ..operators.asof import last_before
from ..operators.skew import split_join
from ..sources.shared import kept

GROUP = "array<struct<agents:array<string>,rules:array<struct<allow:boolean,pattern:string>>>>"


def groups(text: Column) -> Column:
    """array of struct(agents, rules): agents that follow one another share the rules below them; comments, empty rules and rules before any agent don't count."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", ""))), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("value")))
    none = F.struct(F.array().cast(GROUP).alias("made"), F.lit(False).alias("naming"))

    def rule(x: Column) -> Column:
        return F.struct((x["field"] == "allow").alias("allow"), x["value"].alias("pattern"))

    def add(acc: Column, x: Column) -> Column:
        made, last = acc["made"], F.get(acc["made"], F.size(acc["made"]) - 1)
        before = F.slice(made, 1, F.greatest(F.size(made) - 1, F.lit(0)))
        agent, own = x["field"] == "user-agent", x["field"].isin("allow", "disallow")
        fresh = F.array_append(made, F.struct(F.array(F.lower(x["value"])).alias("agents"), F.array().cast("array<struct<allow:boolean,pattern:string>>").alias("rules")))
        named = F.array_append(before, F.struct(F.array_append(last["agents"], F.lower(x["value"])).alias("agents"), last["rules"].alias("rules")))
        ruled = F.array_append(before, F.struct(last["agents"].alias("agents"), F.array_append(last["rules"], rule(x)).alias("rules")))
        out = F.when(agent & acc["naming"] & (F.size(made) > 0), named).when(agent, fresh).when(own & (F.size(made) > 0) & (x["value"] != ""), ruled).otherwise(made)
        return F.struct(out.alias("made"), F.when(agent, F.lit(True)).when(own & (F.size(made) > 0), F.lit(False)).otherwise(acc["naming"]).alias("naming"))

    return F.aggregate(pairs, none, add)["made"]


def rules_for(found: Column, agent: Column) -> Column:
    """Rules of all groups that name the agent; of those for * where none does."""
    token = agent_token(agent)
    own = F.filter(found, lambda g: F.array_contains(g["agents"], token))
    return F.flatten(F.transform(F.when(F.size(own) > 0, own).otherwise(F.filter(found, lambda g: F.array_contains(g["agents"], F.lit("*")))), lambda g: g["rules"]))


def pattern_regex(pattern: Column) -> Column:
    """The regular expression of a pattern: * is anything, $ the end, all else itself."""
    safe = F.regexp_replace(pattern, r"([.+?^{}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(safe, F.lit("*"), F.lit(".*")))


def allowed(rules: Column, path: Column) -> Column:
    """The longest pattern that the path begins with decides, Allow on a tie; without one the path is allowed."""
    hits = F.transform(F.filter(rules, lambda r: F.regexp(path, pattern_regex(r["pattern"]))), lambda r: F.struct(F.length(r["pattern"]).alias("size"), r["allow"].alias("allow")))
    return F.coalesce(F.array_max(hits)["allow"], F.lit(True))


def decide(pages: DataFrame, files: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """pages with allowed, by the robots file (host, text) of each page's host; hosts without one allow all. files has one row a host."""
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.coalesce(F.nullif(F.regexp_extract(F.col(url), r"^[A-Za-z]+://[^/?#]+([^#]*)", 1), F.lit("")), F.lit("/"))
    known = files.select(F.lower("host").alias("__host"), rules_for(groups(F.col("text")), F.lit(agent)).alias("__rules"))
    joined = pages.withColumn("__host", host).join(known, "__host", "left")
    return joined.withColumn("allowed", F.coalesce(allowed(F.col("__rules"), path), F.lit(True))).drop("__host", "__rules")


#: Seconds that a read or missing robots file holds, and one that couldn't be read.
HOLDS, HOLDS_FAILED = 6 * 3600, 300


def readings(fetches: DataFrame) -> DataFrame:
    """fetches (host, fetched_at, status, text, fetch_id) with mode, file (the text's digest) and holds: 'rules' of a file that was read, 'all' without one (4xx), 'none' where the host failed (5xx, or no answer: null)."""
    status = F.col("status")
    mode = F.when(status.between(400, 499), "all").when(status.between(200, 399), "rules").otherwise("none")
    rows = fetches.withColumn("mode", mode).withColumn("file", F.when(F.col("mode") == "rules", F.md5(F.coalesce("text", F.lit("")))))
    return rows.withColumn("holds", F.when(F.col("mode") == "none", HOLDS_FAILED).otherwise(HOLDS)).drop("text", "status")


def decide_at(visits: DataFrame, fetches: DataFrame, agent: str, url: str = "url", at: str = "at") -> DataFrame:
    """visits with mode and allowed, by the last robots file fetched of each one's host by then; 'stale' and null where there is none or it holds no more: it has to be fetched before the page.

    A later fetch replaces an earlier one, also where it failed. Times are timestamps. Each different file is read once, however often it was fetched.
    """
    host = F.nullif(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    path = F.coalesce(F.nullif(F.regexp_extract(F.col(url), r"^[A-Za-z]+://[^/?#]+([^#]*)", 1), F.lit("")), F.lit("/"))
    facts = readings(fetches).withColumn("host", F.lower("host"))
    told = kept(last_before(visits.withColumn("host", host), facts, "host", at, "fetched_at", HOLDS, ("mode", "file", "holds", "fetched_at"), "fetch_id"), "visits")
    files = fetches.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("file")).agg(F.any_value("text").alias("text"))
    asked = told.filter("file is not null").groupBy("file").agg(F.count(F.lit(1)).alias("__n")).join(files, "file").select("file", "__n", rules_for(groups(F.col("text")), F.lit(agent)).alias("rules"))
    told = split_join(told, asked, ["file"], "__n", told.count(), "left")
    fresh = F.coalesce((F.unix_micros(at) - F.unix_micros("fetched_at")) < F.col("holds").cast("long") * 1_000_000, F.lit(False))
    verdict = F.when(F.col("mode") == "all", F.lit(True)).when(F.col("mode") == "none", F.lit(False)).otherwise(allowed(F.col("rules"), path))
    return told.withColumn("allowed", F.when(fresh, verdict)).withColumn("mode", F.when(fresh, F.col("mode")).otherwise("stale")).drop("rules", "file", "holds", "fetched_at", "host")
