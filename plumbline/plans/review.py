"""Text review: corpus, work units, analysis by a user function, findings, attribution."""

from __future__ import annotations

import traceback
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions import vocabulary as V
from plumbline.functions.predicates import has_text, matching_labels, or_null
from plumbline.operators.containment import contained
from plumbline.operators.ordered import islands, joined_text, newest, renumber
from plumbline.operators.similarity import (SKETCH, WIDE, greedy_leaders, signatures_match, word_order, word_overlap, word_signatures, words,
                                            words_near, words_near_wide)
from plumbline.session import cut_lineage, free

# --- corpus -----------------------------------------------------------------------


def corpus(passages: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(project_id, pos, file, para, content, marked): passages under their source marker.

    Projects without any passage fall back to the texts of requirements and services.
    passages and entities have project_id, pos, file, para, content.
    """
    rows = passages.filter(has_text("content"))
    if entities is not None:
        other = entities.filter(has_text("content"))
        rows = rows.unionByName(other.join(rows.select("project_id").distinct(), "project_id", "left_anti"))
    marker = X.source_marker(F.col("file"), F.col("para"))
    return rows.select("project_id", "pos", F.coalesce("file", F.lit("Unbekannte Datei")).alias("file"), "para", "content",
                       F.concat(marker, F.lit("\n"), "content").alias("marked"))


def corpus_text(rows: DataFrame) -> DataFrame:
    return joined_text(rows, ["project_id"], "pos", F.col("marked"), "\n\n")


def document_text(rows: DataFrame) -> DataFrame:
    """All parts of a document under one unit, wherever they stand in the corpus."""
    return joined_text(rows, ["project_id", "file"], "pos", F.col("marked"), "\n\n")


def document_runs(rows: DataFrame) -> DataFrame:
    """Contiguous runs of one document; `is_last` marks the run that a later run does not replace."""
    runs = islands(rows, ["project_id"], "pos", "file", "run")
    last = runs.groupBy("project_id", "file").agg(F.max("run").alias("_last"))
    return runs.join(last, ["project_id", "file"]).withColumn("is_last", F.col("run") == F.col("_last")).drop("_last")


def category_lines(rows: DataFrame) -> DataFrame:
    """Each line of the marked text under every category it has a word of."""
    lines = rows.select("project_id", "pos", F.posexplode(F.split("marked", "\n")).alias("line_idx", "line"))
    return lines.select("project_id", "pos", "line_idx", "line",
                        F.explode(matching_labels("line", V.REVIEW_CATEGORIES)).alias("category"))


def category_text(rows: DataFrame) -> DataFrame:
    """Lines of a category as text; lines of one passage are joined first."""
    lines = category_lines(rows).groupBy("project_id", "category", "pos").agg(
        F.array_sort(F.collect_list(F.struct("line_idx", "line"))).alias("l"))
    passage = lines.withColumn("text", F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return joined_text(passage, ["project_id", "category"], "pos", F.col("text"), "\n")


def work_units(rows: DataFrame) -> DataFrame:
    """Units of all three passes: documents, categories, whole corpus."""
    docs = document_text(rows).select("project_id", F.lit("document").alias("pass"), F.col("file").alias("unit"), "part", "text")
    cats = category_text(rows).select("project_id", F.lit("category").alias("pass"), F.col("category").alias("unit"), "part", "text")
    whole = corpus_text(rows).select("project_id", F.lit("whole").alias("pass"), F.lit("").alias("unit"), "part", "text")
    return docs.unionByName(cats).unionByName(whole)


def token_budget(rows: DataFrame, keys: list[str], prompt: Column, text: Column, limit: int = V.TOKEN_WARNING) -> DataFrame:
    """Estimated tokens per unit; units above the limit are flagged."""
    est = X.estimated_tokens(prompt, text)
    return rows.groupBy(*keys).agg(
        F.sum(est).alias("tokens"), F.count_if(est > limit).alias("units_over"), F.count(F.lit(1)).alias("units"))


# --- analysis -----------------------------------------------------------------------


def analyse(units: DataFrame, analyser: Callable[[str, str], str]) -> DataFrame:
    """Run analyser(unit, text) on every unit. A failure becomes an error row, the others go on."""
    schema = "project_id bigint, pass string, unit string, part bigint, response string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for unit, text in zip(batch["unit"], batch["text"]):
                try:
                    answers.append(analyser(unit, text))
                    errors.append(None)
                except Exception:
                    answers.append(None)
                    errors.append(traceback.format_exc(limit=1))
            yield batch[["project_id", "pass", "unit", "part"]].assign(response=answers, error=errors)

    return units.select("project_id", "pass", "unit", "part", "text").mapInPandas(run, schema)


ANALYSED = "key string, response string, error string, wave int, run string"


def unit_key() -> Column:
    """What a unit's answer depends on: pass, unit and text."""
    return F.sha2(F.to_json(F.struct("pass", "unit", "text")), 256)


def analyse_with_ledger(units: DataFrame, analyser: Callable[[list[tuple[str, str]]], list[str]], ledger: str,
                        units_per_call: int = 16, units_per_wave: int = 10_000) -> DataFrame:
    """Like analyse, but what is answered stays answered: (project_id, pass, unit, part, response, error).

    analyser gets a list of (unit, text) and returns as many answers. The units go in waves of some `units_per_wave`,
    each appended to the ledger below `ledger` once it is done, so a run that breaks off repeats the calls of one
    wave at most, and a lost executor those of its part of it. Units with equal pass, unit and text count once. If
    a call fails its units are asked one by one, so an error is kept for the units that caused it; a later run asks
    these again and nothing else. Null units and texts are passed on as None.
    """
    spark = units.sparkSession
    keyed = cut_lineage(units.select("project_id", "pass", "unit", "part", "text", unit_key().alias("key")), "units")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def answered() -> DataFrame:
        return spark.read.schema(ANALYSED).parquet(ledger) if files.exists(at) else spark.createDataFrame([], ANALYSED)

    def ask(pairs: list[tuple[str, str]]) -> Iterator[tuple[str | None, str | None]]:
        try:
            answers = analyser(pairs)
            if len(answers) != len(pairs):
                raise ValueError(f"{len(answers)} answers for {len(pairs)} units")
            yield from ((x, None) for x in answers)
        except Exception:
            if len(pairs) == 1:
                yield None, traceback.format_exc(limit=1)
            else:
                for pair in pairs:
                    yield from ask([pair])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [(None if pd.isna(u) else u, None if pd.isna(t) else t) for u, t in zip(batch["unit"], batch["text"], strict=True)]
            found = [x for k in range(0, len(pairs), units_per_call) for x in ask(pairs[k:k + units_per_call])]
            yield pd.DataFrame({"key": batch["key"], "response": pd.Series([a for a, _ in found], dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

    done = answered().filter("error is null").select("key")
    todo = cut_lineage(keyed.select("key", "unit", "text").dropDuplicates(["key"]).join(done, "key", "left_anti"), "todo")
    waves = -(-todo.count() // units_per_wave)
    name = uuid.uuid4().hex
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for wave in range(waves):
        rows = todo.filter(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave).repartition(parts)
        found = rows.mapInPandas(run, "key string, response string, error string")
        found.select("*", F.lit(wave).alias("wave"), F.lit(name).alias("run")).write.mode("append").parquet(ledger)
    # an answer counts, else the last error
    state = answered().groupBy("key").agg(F.max("response").alias("response"), F.max_by("error", F.col("run") == name).alias("error"))
    state = state.select("key", "response", F.when(F.col("response").isNull(), F.col("error")).alias("error"))
    return keyed.join(state, "key").select("project_id", "pass", "unit", "part", "response", "error")


ANSWER = "allgemeine_einschaetzung string, kritische_punkte array<string>, _corrupt_record string"
POINT = ("nummer string, titel string, zitat string, beurteilung string, risiko_rating string, empfehlung string, "
         "quelle_datei string, quelle_paragraph string")
QUESTIONS = "zusammenfassung string, fragen array<string>, _corrupt_record string"
QUESTION = "nummer string, kategorie string, frage string, begruendung string, prioritaet string"


def _clean(c: str) -> Column:
    return X.strip(F.coalesce(F.col(c), F.lit("")))


def _items(answers: DataFrame, outer: str, items: str, inner: str) -> DataFrame:
    """Objects of the list in an answer with their position; other list entries are passed over."""
    parsed = answers.withColumn("_a", F.from_json(X.without_fence("response"), outer, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    keep = [c for c in answers.columns if c != "response"]
    rows = parsed.select(*keep, F.posexplode(f"_a.{items}").alias("item_idx", "_raw")).filter(F.trim("_raw").startswith("{"))
    return rows.withColumn("_p", F.from_json("_raw", inner)).select(*keep, "item_idx", "_p.*")


def findings_from_answers(answers: DataFrame) -> DataFrame:
    """Typed findings; those without a title are dropped, an unknown rating becomes orange.

    `number` is the given one, else the count of kept findings before it plus one.
    """
    rows = _items(answers, ANSWER, "kritische_punkte", POINT).filter(_clean("titel") != "")
    keep = [c for c in answers.columns if c != "response"]
    return rows.select(
        *keep, "item_idx", F.col("nummer").try_cast("int").alias("number"), _clean("titel").alias("title"),
        _clean("zitat").alias("quote"), _clean("beurteilung").alias("assessment"),
        X.rating("risiko_rating").alias("rating"), _clean("empfehlung").alias("advice"),
        or_null(_clean("quelle_datei")).alias("source_file"), F.col("quelle_paragraph").try_cast("int").alias("source_para"))


def questions_from_answers(answers: DataFrame) -> DataFrame:
    rows = _items(answers, QUESTIONS, "fragen", QUESTION).filter(_clean("frage") != "")
    keep = [c for c in answers.columns if c != "response"]
    return rows.select(
        *keep, "item_idx", F.col("nummer").try_cast("int").alias("number"), _clean("kategorie").alias("category"),
        _clean("frage").alias("question"), _clean("begruendung").alias("reason"), X.priority("prioritaet").alias("priority"))


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Fill missing numbers with the position among the kept rows."""
    return renumber(rows, keys, "item_idx", "_n").withColumn("number", F.coalesce("number", F.col("_n").cast("int"))).drop("_n")


def bad_answers(answers: DataFrame, shape: str = ANSWER) -> DataFrame:
    """Answers that are not a JSON object, with the start of their text for the log."""
    body = X.without_fence("response")
    parsed = F.from_json(body, shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return answers.withColumn("_bad", parsed["_corrupt_record"].isNotNull() | ~body.startswith("{")).filter("_bad").drop("_bad")


def overall_assessment(answers: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Non-empty assessments of a project in order, joined with a bar."""
    text = F.from_json(X.without_fence("response"), ANSWER)["allgemeine_einschaetzung"]
    rows = answers.withColumn("_t", X.strip(F.coalesce(text, F.lit("")))).filter(F.col("_t") != "")
    return joined_text(rows, keys, order, F.col("_t"), " | ", "assessment")


def distinct_findings(findings: DataFrame, scope: list[str], pos: str = "pos") -> DataFrame:
    """Drop findings whose quote equals, or shares over 0.8 of its words with, a kept one; renumber."""
    key = [*scope, pos]
    known = findings.filter(" and ".join(f"`{c}` is not null" for c in key))
    rows = known.withColumn("_q", F.lower(X.strip(F.coalesce("quote", F.lit("")))))
    bags = cut_lineage(rows.select(*key, words(F.col("_q")).alias("_w")))
    order = word_order(bags, "_w")
    signatures = cut_lineage(word_signatures(bags, scope, pos, "_w", order).drop(WIDE), "signatures")
    empty = cut_lineage(bags.filter(F.size("_w") == 0).select(*key))
    free(bags)
    # most findings are near no other one and stay; empty quotes have no words to tell
    open_keys = cut_lineage(signatures_match(signatures, scope, pos).unionByName(empty).distinct())
    # only keys and words go through the comparison, the findings themselves join at the end
    free(signatures)
    first = rows.join(open_keys, key, "left_semi").groupBy(*scope, "_q").agg(F.min(pos).alias(pos))
    bags = cut_lineage(first.select(*key, words(F.col("_q")).alias("_w")))
    signatures = cut_lineage(word_signatures(bags, scope, pos, "_w", order), "signatures")
    blocks = signatures.select(*key, "size", F.explode("_tokens").alias("token"), *SKETCH)
    items = bags.join(signatures.select(*key, "size", WIDE), key, "left")
    led = greedy_leaders(items, blocks, scope, pos, ["_w"], lambda new, old: word_overlap(new("_w"), old("_w")) > 0.8, size_ratio=0.8,
                         near=words_near, traits=SKETCH, screen=words_near_wide, screened=["size", WIDE])
    kept = led.filter(F.col(pos) == F.col("leader")).select(*key)
    lost = open_keys.join(kept, key, "left_anti")
    return renumber(known.drop("number").join(lost, key, "left_anti"), scope, pos, "number")


# --- attribution ----------------------------------------------------------------------


def first_passage(quotes: DataFrame, passages: DataFrame, scope: list[str]) -> DataFrame:
    """Per quote the first passage that holds it or that it holds; an empty quote takes the first passage.

    quotes: scope, quote_id, quote. passages: scope, pos, content. Case is folded.
    """
    asked = quotes.select(*scope, F.col("quote_id").alias("_asked"), F.lower("quote").alias("quote"))
    # equal quotes share their answer, and of equal passages only the first can be one
    q = asked.groupBy(*scope, "quote").agg(F.min("_asked").alias("quote_id"))
    p = passages.groupBy(*scope, F.lower("content").alias("content")).agg(F.min("pos").alias("pos"))
    q, p = cut_lineage(q, "quotes"), cut_lineage(p, "passages")
    inside = contained(q, p, scope, "quote", "quote_id", "content", "pos")
    around = contained(p, q, scope, "content", "pos", "quote", "quote_id")
    # an empty quote lies in every passage, an empty passage in every quote
    first = p.groupBy(*scope).agg(F.min("pos").alias("_first"),
                                  F.min(F.when(F.col("content") == "", F.col("pos"))).alias("_blank"))
    if scope:
        edge = q.join(first, scope)
    else:
        edge = q.withColumn("_first", first.select("_first").scalar()).withColumn("_blank", first.select("_blank").scalar())
    edge = edge.select(*scope, "quote_id", F.when(F.col("quote") == "", F.col("_first")).otherwise(F.col("_blank")).alias("pos")
                       ).filter("pos is not null")
    found = inside.select(*scope, "quote_id", "pos").unionByName(around.select(*scope, "quote_id", "pos")).unionByName(
        edge).groupBy(*scope, "quote_id").agg(F.min("pos").alias("pos"))
    answers = found.join(q, [*scope, "quote_id"]).select(*scope, "quote", "pos")
    return asked.join(answers, [*scope, "quote"]).select(*scope, F.col("_asked").alias("quote_id"), "pos")


def after_marker(rows: DataFrame, chars: int = V.MARKER_WINDOW_CHARS, width: int = 4096) -> DataFrame:
    """Per passage the text of the corpus that follows its marker, up to `chars` characters.

    A passage and its marker take at least 14 characters, so `chars` of text span a
    bounded number of rows. Positions are cut into stretches of `width`; each stretch
    also gets the rows just after it, and no window is larger than that.
    """
    from pyspark.sql import Window

    reach = chars // 14 + 1
    width = max(width, reach)
    # dense numbers, because positions of dropped passages leave holes
    dense = renumber(rows, ["project_id"], "pos", "_i").withColumn("_i", F.col("_i") - 1)
    home = F.floor(F.col("_i") / width)
    copies = dense.withColumn("_s", F.explode(F.when(
        (F.col("_i") % width < reach) & (home > 0), F.array(home, home - 1)).otherwise(F.array(home))))
    w = Window.partitionBy("project_id", "_s").orderBy("_i").rowsBetween(1, reach)
    following = F.concat_ws("\n\n", F.collect_list(F.left("marked", F.lit(chars + 2))).over(w))
    own = F.concat(F.lit("\n"), F.col("content"))
    tail = copies.withColumn("_next", following).filter(F.col("_s") == F.floor(F.col("_i") / width))
    return tail.select(
        "project_id", "pos", "file", "para",
        F.left(F.when(F.col("_next") == "", own).otherwise(F.concat(own, F.lit("\n\n"), "_next")), F.lit(chars)).alias("window"))


def attribute(findings: DataFrame, rows: DataFrame) -> DataFrame:
    """Source file and paragraph of findings that have none: by passage, then by the text after a marker."""
    open_rows = findings.filter(~has_text("source_file"))
    q = cut_lineage(open_rows.select("project_id", F.col("pos").alias("quote_id"), F.coalesce("quote", F.lit("")).alias("quote")))
    one = cut_lineage(first_passage(q, rows, ["project_id"]).select("project_id", "quote_id", F.col("pos").alias("_at")))
    rest = q.join(one, ["project_id", "quote_id"], "left_anti").select("project_id", "quote_id", F.lower("quote").alias("quote"))
    # only projects that still have an open quote need their windows
    asking = rows.join(rest.select("project_id").distinct(), "project_id", "left_semi")
    windows = after_marker(asking).select("project_id", "pos", F.lower("window").alias("window"))
    two = contained(rest, windows, ["project_id"], "quote", "quote_id", "window", "pos").groupBy(
        "project_id", "quote_id").agg(F.min("pos").alias("_at"))
    at = one.unionByName(two).join(
        rows.select("project_id", F.col("pos").alias("_at"), F.col("file").alias("_file"), (F.col("para") + 1).alias("_para")),
        ["project_id", "_at"]).select("project_id", F.col("quote_id").alias("pos"), "_file", "_para")
    return findings.join(at, ["project_id", "pos"], "left").withColumns({
        "source_file": F.coalesce(or_null("source_file"), "_file"),
        "source_para": F.coalesce("source_para", "_para")}).drop("_file", "_para")


# --- history ------------------------------------------------------------------------------


def review_history(reviews: DataFrame, keep: int = V.REVIEW_HISTORY) -> DataFrame:
    """The newest reviews of each project."""
    return newest(reviews, ["project_id"], [F.desc("created_at"), F.desc("review_id")], keep)


def latest_review(reviews: DataFrame) -> DataFrame:
    names = [c for c in reviews.columns if c != "project_id"]
    return reviews.groupBy("project_id").agg(
        F.max_by(F.struct(*names), F.struct("created_at", "review_id")).alias("r")).select("project_id", "r.*")
