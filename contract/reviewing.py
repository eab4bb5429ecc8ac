"""Text review: corpus, units, answers, attribution, history."""

from pyspark.sql import functions as F

from contract import query
from contract import standins as S
from contract.scalars import any_sql
from plumbline.functions import vocabulary as V
from plumbline.operators.ordered import as_of
from plumbline.plans import review as L
from plumbline.session import scratch_path


@query(f"WITH {S.PASSAGES} SELECT project_id, pos, file, para, marked FROM corpus")
def review_corpus(spark, sf):
    return L.corpus(S.passages(spark, sf)).select("project_id", "pos", "file", F.col("para").cast("long").alias("para"), "marked")


@query(f"""WITH {S.PASSAGES}, alt AS (SELECT p_partkey * 10 AS project_id, p_partkey AS pos, p_type AS file, p_name AS content FROM part)
  SELECT project_id, pos, marked FROM corpus UNION ALL SELECT project_id, pos, '[Datei: ' || file || ']' || chr(10) || content FROM alt WHERE project_id NOT IN (SELECT project_id FROM corpus)""")
def review_corpus_whole(spark, sf):
    """All passages; texts of parts for the projects that have none."""
    alt = S.read(spark, sf, "part").select((F.col("p_partkey") * 10).alias("project_id"), F.col("p_partkey").alias("pos"), F.col("p_type").alias("file"),
                                           F.lit(None).cast("int").alias("para"), F.col("p_name").alias("content"))
    return L.corpus(S.passages(spark, sf), alt).select("project_id", "pos", "marked")


@query(f"WITH {S.PASSAGES} SELECT project_id, 0::BIGINT AS part, string_agg(marked, chr(10) || chr(10) ORDER BY pos) AS text FROM corpus GROUP BY 1")
def corpus_text(spark, sf):
    return L.corpus_text(L.corpus(S.passages(spark, sf)))


@query(f"WITH {S.PASSAGES} SELECT project_id, file, 0::BIGINT AS part, string_agg(marked, chr(10) || chr(10) ORDER BY pos) AS text FROM corpus GROUP BY 1, 2")
def document_units(spark, sf):
    return L.document_text(L.corpus(S.passages(spark, sf)))


@query(f"""WITH {S.PASSAGES}, p AS (SELECT *, lag(file) OVER (PARTITION BY project_id ORDER BY pos) AS before FROM corpus),
  r AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> file THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY pos)::BIGINT AS run FROM p)
  SELECT project_id, pos, file, run, run = max(run) OVER (PARTITION BY project_id, file) AS is_last FROM r""")
def document_runs(spark, sf):
    return L.document_runs(L.corpus(S.passages(spark, sf))).select("project_id", "pos", "file", "run", "is_last")


CATS = " UNION ALL ".join(f"SELECT project_id, pos, i, line, '{c}' AS category FROM ml WHERE {any_sql('line', ws)}" for c, ws in V.REVIEW_CATEGORIES.items())
CATEGORY = f"""{S.PASSAGES}, ml AS (SELECT project_id, pos, unnest(string_split(marked, chr(10))) AS line, unnest(range(0, len(string_split(marked, chr(10))))) AS i FROM corpus), cats AS ({CATS})"""


@query(f"WITH {CATEGORY} SELECT project_id, category, 0::BIGINT AS part, string_agg(line, chr(10) ORDER BY pos, i) AS text FROM cats GROUP BY 1, 2")
def category_units(spark, sf):
    return L.category_text(L.corpus(S.passages(spark, sf)))


@query(f"""WITH {CATEGORY}, units AS (
  SELECT project_id, 'document' AS pass, file AS unit, string_agg(marked, chr(10) || chr(10) ORDER BY pos) AS text FROM corpus GROUP BY 1, 3 UNION ALL
  SELECT project_id, 'category', category, string_agg(line, chr(10) ORDER BY pos, i) FROM cats GROUP BY 1, 3 UNION ALL
  SELECT project_id, 'whole', '', string_agg(marked, chr(10) || chr(10) ORDER BY pos) FROM corpus GROUP BY 1)
  SELECT project_id, pass, count(*) AS units, sum((7 + length(text)) // 4)::BIGINT AS tokens, count(*) FILTER ((7 + length(text)) // 4 > 1000) AS units_over FROM units GROUP BY 1, 2""")
def work_unit_budget(spark, sf):
    """Units of all three passes with their estimated tokens."""
    units = L.work_units(L.corpus(S.passages(spark, sf)))
    return L.token_budget(units, ["project_id", "pass"], F.lit("Prüfung"), F.col("text"), limit=1000)


@query(f"""WITH {S.PASSAGES} SELECT project_id, 'document' AS pass, file AS unit, CASE WHEN file <> 'system.docx' THEN sum(length(marked)) + 2 * (count(*) - 1) END::VARCHAR AS response,
  file = 'system.docx' AS failed FROM corpus GROUP BY 1, 3""")
def unit_analysis(spark, sf):
    """A user function over units; one kind of unit fails, the others go on."""
    def measure(unit: str, text: str) -> str:
        if unit == "system.docx":
            raise ValueError("no answer")
        return str(len(text))

    units = L.document_text(L.corpus(S.passages(spark, sf))).select("project_id", F.lit("document").alias("pass"), F.col("file").alias("unit"), "part", "text")
    return L.analyse(units, measure).select("project_id", "pass", "unit", "response", F.col("error").isNotNull().alias("failed"))


# --- answers: documents as JSON, every third one in a code fence ----------------------------------


def answers(spark, sf):
    d = S.read(spark, sf, "documents")
    k = F.col("doc_id")
    first = F.struct(F.lit(1).alias("nummer"), F.concat(F.lit(" Titel "), "source").alias("titel"), F.col("text").alias("zitat"),
                     F.when(k % 4 == 0, "ROT").when(k % 4 == 1, "gruen").when(k % 4 == 2, "hoch").otherwise("orange").alias("risiko_rating"))
    second = F.struct(F.lit(None).cast("int").alias("nummer"), F.when(k % 2 == 0, "").otherwise("Zwei").alias("titel"), F.lit("").alias("zitat"), F.lit("").alias("risiko_rating"))
    body = F.to_json(F.struct(F.concat(F.lit("Lage "), "lang").alias("allgemeine_einschaetzung"), F.array(first, second).alias("kritische_punkte")))
    fenced = F.when(k % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k % 10 == 1, "kein json").otherwise(body)
    return d.select(F.col("source").alias("unit"), k.alias("pos"), fenced.alias("response"))


@query("""WITH a AS (SELECT * FROM documents WHERE doc_id % 3 = 0 OR doc_id % 10 <> 1)
  SELECT source AS unit, doc_id AS pos, 1::BIGINT AS number, 'Titel ' || source AS title, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS quote,
    CASE doc_id % 4 WHEN 0 THEN 'rot' WHEN 1 THEN 'grün' ELSE 'orange' END AS rating FROM a UNION ALL
  SELECT source, doc_id, 2, 'Zwei', '', 'orange' FROM a WHERE doc_id % 2 = 1""")
def findings_from_answers(spark, sf):
    rows = L.numbered(L.findings_from_answers(answers(spark, sf)), ["pos"])
    return rows.select("unit", "pos", F.col("number").cast("long").alias("number"), "title", "quote", "rating")


@query("SELECT source AS unit, doc_id AS pos FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 10 = 1")
def unreadable_answers(spark, sf):
    return L.bad_answers(answers(spark, sf)).select("unit", "pos")


@query("""SELECT conv_id AS pos, turn AS item_idx, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, role AS category, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS question,
  CASE role WHEN 'user' THEN 'hoch' WHEN 'assistant' THEN 'niedrig' ELSE 'mittel' END AS priority FROM conversations
  WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''""")
def questions_from_answers(spark, sf):
    """One answer per turn, numbered over the conversation."""
    c = S.read(spark, sf, "conversations")
    item = F.struct(F.col("role").alias("kategorie"), F.col("text").alias("frage"), F.when(F.col("role") == "user", "High").when(F.col("role") == "assistant", "low!").alias("prioritaet"))
    body = F.to_json(F.struct(F.lit("Z").alias("zusammenfassung"), F.array(item).alias("fragen")))
    q = L.questions_from_answers(c.select(F.col("conv_id").alias("pos"), F.col("turn"), body.alias("response"))).drop("item_idx").withColumnRenamed("turn", "item_idx")
    return L.numbered(q, ["pos"]).select("pos", "item_idx", F.col("number").cast("long").alias("number"), "category", "question", "priority")


@query("""SELECT source AS unit, 0::BIGINT AS part, string_agg('Lage ' || lang, ' | ' ORDER BY doc_id) AS assessment FROM documents WHERE doc_id % 3 = 0 OR doc_id % 10 <> 1 GROUP BY 1""")
def overall_assessments(spark, sf):
    return L.overall_assessment(answers(spark, sf), ["unit"], "pos")


# --- attribution --------------------------------------------------------------------------------


@query(f"""WITH {S.LINES}, l AS (SELECT file_id * 1000000 + para_idx AS pos, lower(text) AS t FROM lines), q AS (SELECT item_id AS quote_id, lower({S.worded_sql('text')}) AS q FROM benchmark)
  SELECT quote_id, min(pos) AS pos FROM q JOIN l ON contains(t, q) OR contains(q, t) GROUP BY 1""")
def first_passage_of_quote(spark, sf):
    """Benchmark items as quotes, every line of every document as a passage; either may hold the other."""
    q = S.read(spark, sf, "benchmark").select(F.col("item_id").alias("quote_id"), S.worded("text").alias("quote"))
    p = S.lines(spark, sf).select((F.col("file_id") * 1000000 + F.col("para_idx")).alias("pos"), F.col("text").alias("content"))
    return L.first_passage(q, p, [])


@query("""SELECT item_id AS quote_id, doc_id AS pos FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))""")
def documents_holding_quote(spark, sf):
    from plumbline.operators.containment import contained
    q = S.read(spark, sf, "benchmark").select(F.col("item_id").alias("quote_id"), F.lower("text").alias("quote"))
    d = S.read(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.lower("text").alias("content"))
    return contained(q, d, [], "quote", "quote_id", "content", "pos")


def _findings(spark, sf):
    """Quotes from inside a passage, across two passages, around a passage, and from nowhere."""
    from plumbline.operators.ordered import previous
    c = L.corpus(S.passages(spark, sf))
    following = previous(c.withColumn("_back", -F.col("pos")), ["project_id"], "_back", F.col("marked"), "_next")
    across = F.concat(F.right("content", F.lit(8)), F.lit("\n\n"), F.left("_next", F.lit(40)))
    t = F.col("pos") % 5
    quote = (F.when(t == 0, F.substring("content", 5, 40)).when(t == 1, across).when(t == 2, F.concat(F.lit("xx "), "content", F.lit(" yy")))
             .when(t == 3, F.concat(F.lit("kein Treffer "), F.col("pos").cast("string"))).otherwise(""))
    return c, following.select("project_id", "pos", quote.alias("quote"), F.when(F.col("pos") % 7 == 0, "bekannt.pdf").otherwise("").alias("source_file"),
                       F.lit(None).cast("int").alias("source_para"))


@query(f"""WITH {S.PASSAGES}, n AS (SELECT *, lead(marked) OVER (PARTITION BY project_id ORDER BY pos) AS nxt FROM corpus),
  f AS (SELECT project_id, pos AS fpos, coalesce(CASE pos % 5 WHEN 0 THEN substr(content, 5, 40) WHEN 1 THEN right(content, 8) || chr(10) || chr(10) || left(nxt, 40)
      WHEN 2 THEN 'xx ' || content || ' yy' WHEN 3 THEN 'kein Treffer ' || pos ELSE '' END, '') AS quote, CASE WHEN pos % 7 = 0 THEN 'bekannt.pdf' ELSE '' END AS known FROM n),
  one AS (SELECT f.project_id, fpos, min(c.pos) AS p FROM f JOIN corpus c ON c.project_id = f.project_id AND (contains(lower(c.content), lower(quote)) OR contains(lower(quote), lower(c.content)))
    WHERE known = '' GROUP BY 1, 2),
  ft AS (SELECT project_id, string_agg(marked, chr(10) || chr(10) ORDER BY pos) AS full_text FROM corpus GROUP BY 1),
  o AS (SELECT project_id, pos, coalesce(sum(length(marked) + 2) OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
      + length(marked) - length(content) - 1 AS marker_end FROM corpus),
  win AS (SELECT o.project_id, o.pos, lower(substr(full_text, marker_end + 1, 2000)) AS w FROM o JOIN ft USING (project_id)),
  two AS (SELECT f.project_id, fpos, min(win.pos) AS p FROM f JOIN win ON win.project_id = f.project_id AND contains(w, lower(quote))
    WHERE known = '' AND NOT EXISTS (SELECT 1 FROM one WHERE one.project_id = f.project_id AND one.fpos = f.fpos) GROUP BY 1, 2),
  hit AS (SELECT * FROM one UNION ALL SELECT * FROM two)
  SELECT f.project_id, f.fpos AS pos, coalesce(nullif(known, ''), c.file) AS source_file, c.para + 1 AS source_para
  FROM f LEFT JOIN hit ON hit.project_id = f.project_id AND hit.fpos = f.fpos LEFT JOIN corpus c ON c.project_id = hit.project_id AND c.pos = hit.p""")
def quote_attribution(spark, sf):
    corpus, findings = _findings(spark, sf)
    return L.attribute(findings, corpus).select("project_id", "pos", "source_file", F.col("source_para").cast("long").alias("source_para"))


# --- history -----------------------------------------------------------------------------------------


def _reviews(spark, sf):
    return S.read(spark, sf, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("review_id"), F.col("o_orderdate").alias("created_at"), "o_orderstatus")


@query("""SELECT project_id, review_id FROM (SELECT o_custkey AS project_id, o_orderkey AS review_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 10""")
def review_history(spark, sf):
    return L.review_history(_reviews(spark, sf)).select("project_id", "review_id")


@query("SELECT o_custkey AS project_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS review_id, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1")
def latest_review(spark, sf):
    return L.latest_review(_reviews(spark, sf)).select("project_id", "review_id", F.col("o_orderstatus").alias("status"))


@query(f"""WITH {S.PASSAGES}, u AS (SELECT project_id, file AS unit, sum(length(marked)) + 2 * (count(*) - 1) AS n FROM corpus GROUP BY 1, 2)
  SELECT project_id, unit, CASE WHEN n % 5 <> 0 THEN n END::VARCHAR AS response, n % 5 = 0 AS failed FROM u""")
def unit_analysis_resumed(spark, sf):
    """A first run answers the units of even length, a second one asks for the rest only; some units fail each time."""
    def measure(pairs, odd=True):
        if any(len(t) % 5 == 0 or (len(t) % 2 and not odd) for _, t in pairs):
            raise ValueError("no answer")
        return [str(len(t)) for _, t in pairs]

    units = L.document_text(L.corpus(S.passages(spark, sf))).select("project_id", F.lit("document").alias("pass"), F.col("file").alias("unit"), "part", "text")
    ledger = scratch_path(spark, "ledger")
    L.analyse_with_ledger(units, lambda pairs: measure(pairs, odd=False), ledger)
    return L.analyse_with_ledger(units, measure, ledger).select("project_id", "unit", "response", F.col("error").isNotNull().alias("failed"))


AS_OF = """l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 10 END AS g, o_orderdate AS at FROM orders),
  r AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey % 10 END AS g, l_shipdate AS at, max(l_orderkey) AS v FROM lineitem GROUP BY 1, 2)"""


@query(f"""WITH {AS_OF} SELECT l.o_orderkey, l.g, strftime(r.at, '%Y-%m-%d') AS shipped, r.v AS last_order FROM l ASOF LEFT JOIN r ON l.g = r.g AND l.at >= r.at""")
def last_shipment_before(spark, sf):
    """For each order the last shipment of its group on or before its day; one group holds a third of both tables."""
    left = S.read(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey") % 10).alias("g"), F.col("o_orderdate").alias("at"))
    right = S.read(spark, sf, "lineitem").select(F.when(F.col("l_orderkey") % 3 == 0, 0).otherwise(F.col("l_suppkey") % 10).alias("g"), F.col("l_shipdate").alias("at"), F.col("l_orderkey").alias("v"))
    out = as_of(left, right, ["g"], "at", {"at": "since", "v": "last_order"}, "v")
    return out.select("o_orderkey", "g", F.date_format("since", "yyyy-MM-dd").alias("shipped"), "last_order")
