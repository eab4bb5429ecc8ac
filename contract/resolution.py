"""Merges of all entity kinds whose names are alike, not equal: the string ratio decides, in Spark and in SQL."""

from pyspark.sql import functions as F

from contract import query
from contract import standins as S
from plumbline import schema
from plumbline.plans import merge as M
from plumbline.session import scratch_path
from plumbline.streaming import resolution as R

KINDS = ("spaces", "systems", "equipment", "milestones", "requirements")
PARTS = 3  # batches in which the rows arrive


def _of(entity, rows, project, pos, **given):
    """Rows of a kind with the given columns; the batch is the file."""
    given = {"sources": S.one_source(F.concat(F.lit(entity), (pos % PARTS).cast("string")), pos % PARTS), **given}
    columns = [given[c].cast(t).alias(c) if c in given else F.lit(None).cast(t).alias(c) for c, t in R._types(entity).items() if c not in ("project_id", "pos")]
    return rows.select(project.alias("project_id"), pos.alias("pos"), *columns, (pos % PARTS).alias("file_id"))


def arrivals(spark, sf):
    """Rows of all kinds, from the given tables: names are a word and a number, so many are near each other."""
    def text(word, c):
        return F.concat(F.lit(word), F.col(c).cast("string"))

    def every(c, n, value):
        return F.when(F.col(c) % n == 0, value)

    p, s, c, o, b = (F.col(k) for k in ("p_partkey", "s_suppkey", "c_custkey", "o_orderkey", "item_id"))
    cents = {k: F.concat(F.lit(k), (F.col(key) % n).cast("string")) for k, key, n in (("N", "p_partkey", 400), ("G", "p_partkey", 175), ("S", "s_suppkey", 30))}
    return {
        "spaces": _of("spaces", S.read(spark, sf, "part"), p % 25, p, id=text("R", "p_partkey"), name=text("Raum ", "p_size"),
                      number=F.when(p % 11 != 0, cents["N"]).otherwise(""), guid=every("p_partkey", 7, cents["G"]), area_m2=F.when(p % 5 != 0, p % 40)),
        "systems": _of("systems", S.read(spark, sf, "supplier"), s % 5, s, id=text("S", "s_suppkey"), name=text("Anlage ", "s_nationkey"),
                       system_guid=every("s_suppkey", 6, cents["S"]), power_kw=s % 9,
                       space_ids=F.array(F.concat(F.lit("R"), (s % 7).cast("string")), F.lit("R1"))),
        "equipment": _of("equipment", S.read(spark, sf, "customer"), c % 25, c, id=text("G", "c_custkey"), kind=F.col("c_mktsegment"),
                         name=F.when(c % 10 == 0, "").otherwise(text("Gerät ", "c_nationkey")), power_kw=F.when(c % 4 != 0, c % 12)),
        "milestones": _of("milestones", S.read(spark, sf, "orders"), o % 300, o, id=text("T", "o_orderkey"),
                          text=F.concat_ws(" ", F.lit("Abgabe"), "o_orderpriority", (F.col("o_custkey") % 4).cast("string")),
                          due=F.when(o % 6 != 0, F.date_format("o_orderdate", "yyyy"))),
        "requirements": _of("requirements", S.read(spark, sf, "benchmark"), b % 5, b, id=text("Q", "item_id"), text=F.col("text")),
    }


def report(states):
    """One row for each merged entity of all kinds."""
    out = None
    key = ["project_id", "pos"]
    for kind, state in states.items():
        merged, lineage = state["merged"], state["lineage"]
        number = {"spaces": "area_m2", "systems": "power_kw", "equipment": "power_kw"}.get(kind)
        rows = merged.select(*key, "id", F.col("text" if "text" in merged.columns else "name").alias("name"),
                             (F.col(number) if number else F.lit(None).cast("double")).alias("number"))
        rows = rows.join(lineage.groupBy(*key).agg(F.countDistinct("member_pos").alias("members"), F.countDistinct("source.file").alias("files")), key)
        conflicts = state["conflicts"].filter("field = 'area_m2'").select(*key, F.col("new").alias("conflict")) if "conflicts" in state else None
        links = state["links"].filter("field = 'space_ids'").groupBy(*key).agg(F.count(F.lit(1)).alias("links")) if "links" in state else None
        if "space_links" in state:
            links = state["space_links"].groupBy(*key).agg(F.count(F.lit(1)).alias("links"))
        rows = rows.join(conflicts, key, "left") if conflicts is not None else rows.withColumn("conflict", F.lit(None).cast("double"))
        rows = rows.join(links, key, "left") if links is not None else rows.withColumn("links", F.lit(None).cast("long"))
        rows = rows.select(F.lit(kind).alias("entity"), *key, "id", "name", "number", "members", "files", "conflict", "links")
        out = rows if out is None else out.unionByName(rows)
    return out


# --- the same in SQL: matching blocks and the sequential pass by recursion ----------------------------

BEST = """coalesce(list_max(flatten(list_transform(range(al, ah), lambda i: list_transform(range(bl, bh), lambda j:
  coalesce(list_max(list_filter(range(1, least(ah - i, bh - j) + 1), lambda k: substr(a, i + 1, k) = substr(b, j + 1, k))), 0) * 1000000 - i * 1000 - j)))), 0)"""

#: near: pairs of different names of a kind above its threshold. best holds a block's length and, the smaller the better, its places.
NEAR = f"""
  pairs AS (SELECT x.entity, x.name AS a, y.name AS b FROM (SELECT DISTINCT entity, lower(name) AS name FROM arrived WHERE name <> '') x
    JOIN (SELECT DISTINCT entity, lower(name) AS name FROM arrived WHERE name <> '') y ON x.entity = y.entity AND x.name <> y.name AND x.entity <> 'requirements'),
  seg(entity, a, b, al, ah, bl, bh, best) AS (
    SELECT *, {BEST} FROM (SELECT entity, a, b, 0::BIGINT AS al, length(a)::BIGINT AS ah, 0::BIGINT AS bl, length(b)::BIGINT AS bh FROM pairs)
    UNION ALL
    SELECT *, {BEST} FROM (
      SELECT entity, a, b, c.al AS al, c.ah AS ah, c.bl AS bl, c.bh AS bh FROM (
        SELECT entity, a, b, unnest([{{'al': al, 'ah': i, 'bl': bl, 'bh': j}}, {{'al': i + k, 'ah': ah, 'bl': j + k, 'bh': bh}}]) AS c FROM (
          SELECT *, (k * 1000000 - best) // 1000 AS i, (k * 1000000 - best) % 1000 AS j FROM (
            SELECT *, (best + 999999) // 1000000 AS k FROM seg WHERE best > 0)))
      WHERE c.ah > c.al AND c.bh > c.bl)),
  near AS (SELECT entity, a, list(b) AS names FROM (
      SELECT entity, a, b, 2.0::DOUBLE * sum((best + 999999) // 1000000) / (length(a) + length(b)) AS ratio FROM seg WHERE best > 0 GROUP BY entity, a, b)
    WHERE ratio > CASE entity WHEN 'equipment' THEN 0.7 WHEN 'milestones' THEN 0.9 ELSE 0.8 END GROUP BY entity, a)"""

ARRIVED = f"""
  given AS (
    SELECT 'spaces' AS entity, p_partkey % 25 AS project_id, p_partkey AS k, 'R' || p_partkey AS id, 'Raum ' || p_size AS name,
      CASE WHEN p_partkey % 11 <> 0 THEN 'N' || (p_partkey % 400) ELSE '' END AS number, CASE WHEN p_partkey % 7 = 0 THEN 'G' || (p_partkey % 175) END AS guid,
      CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 40)::DOUBLE END AS value, NULL AS kind, NULL AS due, NULL::BIGINT AS link FROM part UNION ALL
    SELECT 'systems', s_suppkey % 5, s_suppkey, 'S' || s_suppkey, 'Anlage ' || s_nationkey, '', CASE WHEN s_suppkey % 6 = 0 THEN 'S' || (s_suppkey % 30) END,
      (s_suppkey % 9)::DOUBLE, NULL, NULL, s_suppkey % 7 FROM supplier UNION ALL
    SELECT 'equipment', c_custkey % 25, c_custkey, 'G' || c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE 'Gerät ' || c_nationkey END, '', NULL,
      CASE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 12)::DOUBLE END, c_mktsegment, NULL, NULL FROM customer UNION ALL
    SELECT 'milestones', o_orderkey % 300, o_orderkey, 'T' || o_orderkey, 'Abgabe ' || o_orderpriority || ' ' || (o_custkey % 4), '', NULL, NULL, NULL,
      CASE WHEN o_orderkey % 6 <> 0 THEN strftime(o_orderdate, '%Y') END, NULL FROM orders UNION ALL
    SELECT 'requirements', item_id % 5, item_id, 'Q' || item_id, text, '', NULL, NULL, NULL, NULL, NULL FROM benchmark),
  arrived AS (SELECT *, k % {PARTS} AS part, row_number() OVER (PARTITION BY entity, project_id ORDER BY k % {PARTS}, k) - 1 AS pos FROM given)"""

#: The sequential pass of all kinds and projects side by side. A row joins the earliest leader that it matches.
PASS = """
  w AS (SELECT a.*, lower(a.name) AS low, coalesce(n.names, []) AS names FROM arrived a LEFT JOIN near n ON a.entity = n.entity AND lower(a.name) = n.a
    WHERE a.entity <> 'requirements'),
  g(entity, project_id, pos, leaders, hit) AS (
    SELECT DISTINCT entity, project_id, -1::BIGINT, []::STRUCT(pos BIGINT, id VARCHAR, low VARCHAR, number VARCHAR, guid VARCHAR, kind VARCHAR, due VARCHAR)[], NULL::BIGINT FROM w
    UNION ALL
    SELECT entity, project_id, pos, CASE WHEN hit IS NULL THEN list_append(leaders, me) ELSE leaders END, hit FROM (
      SELECT w.entity, w.project_id, w.pos, g.leaders, {'pos': w.pos, 'id': w.id, 'low': w.low, 'number': w.number, 'guid': w.guid, 'kind': w.kind, 'due': w.due} AS me,
        list_min([l.pos FOR l IN g.leaders IF CASE w.entity
          WHEN 'milestones' THEN l.due IS NOT DISTINCT FROM w.due AND (l.low = w.low OR list_contains(w.names, l.low))
          WHEN 'equipment' THEN (w.low <> '' AND l.low = w.low) OR (l.kind = w.kind AND (l.low = w.low OR list_contains(w.names, l.low)))
          ELSE coalesce(l.guid = w.guid, false) OR (w.number <> '' AND l.number = w.number) OR l.low = w.low OR list_contains(w.names, l.low) END]) AS hit
      FROM g JOIN w ON w.entity = g.entity AND w.project_id = g.project_id AND w.pos = g.pos + 1)),
  c AS (SELECT w.*, coalesce(g.hit, w.pos) AS leader FROM w JOIN g ON g.entity = w.entity AND g.project_id = w.project_id AND g.pos = w.pos UNION ALL
    SELECT *, lower(name), [], pos FROM arrived WHERE entity = 'requirements'),
  m AS (SELECT entity, project_id, leader AS pos, arg_min(id, pos) AS id, arg_min(name, pos) AS name,
      CASE WHEN entity IN ('spaces', 'systems', 'equipment') THEN arg_min(value, pos) FILTER (value IS NOT NULL) END AS number,
      count(*) AS members, count(DISTINCT part) AS files, count(DISTINCT CASE WHEN link IS NOT NULL AND link <> 1 THEN link END) + 1 AS links
    FROM c GROUP BY entity, project_id, leader)
  SELECT m.entity, m.project_id, m.pos, m.id, m.name, m.number, m.members, m.files,
    (SELECT arg_max(c.value, c.pos) FROM c WHERE c.entity = 'spaces' AND c.entity = m.entity AND c.project_id = m.project_id AND c.leader = m.pos AND abs(c.value - m.number) > 0.01) AS conflict,
    CASE WHEN m.entity = 'systems' THEN m.links END AS links FROM m"""

SQL = f"WITH RECURSIVE {ARRIVED}, {NEAR}, {PASS}"


@query(SQL)
def whole_merge(spark, sf):
    """A batch of files with rows of all kinds, merged in one call."""
    rows = {kind: M.in_arrival_order(None, df).select(*R._types(kind)) for kind, df in arrivals(spark, sf).items()}
    return report(M.merge_all(rows))


@query(SQL)
def incremental_resolution(spark, sf):
    """The same rows as a stream of three uploads, one for each start of the stream: the model is the one of a single pass."""
    out = scratch_path(spark, "resolution")
    for part in range(PARTS):
        for kind, rows in arrivals(spark, sf).items():
            rows.filter(F.col("file_id") == part).withColumn("entity", F.lit(kind)).write.parquet(f"{out}/drop/{kind}-{part}")
        types = {c: t for kind in KINDS for c, t in R._types(kind).items()} | {"file_id": "bigint", "entity": "string"}
        stream = spark.readStream.schema(", ".join(f"{c} {t}" for c, t in types.items())).parquet(f"{out}/drop/*")
        R.model_stream(stream, f"{out}/model", f"{out}/checkpoint", KINDS).awaitTermination()
    return report({kind: R.merged_model(spark, f"{out}/model", kind) for kind in KINDS})
