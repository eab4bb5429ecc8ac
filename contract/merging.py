"""Entity resolution and similarity."""

from pyspark.sql import functions as F

from contract import query
from contract import standins as S
from plumbline.operators import similarity as Sim
from plumbline.plans import merge as M


def _by_name(rows):
    """Clusters by equal name, as a stand-in that SQL can state."""
    lead = rows.groupBy("project_id", "name").agg(F.min("pos").alias("leader"))
    return rows.join(lead, ["project_id", "name"]).select("project_id", "pos", "leader")


NAMED = f"""{S.spaces_sql()}, c AS (SELECT *, min(pos) OVER (PARTITION BY project_id, name) AS leader FROM spaces)"""


@query(f"""WITH {NAMED} SELECT project_id, leader AS pos, arg_min(id, pos) AS id, arg_min(number, pos) FILTER (number IS NOT NULL) AS number,
  arg_min(area_m2, pos) FILTER (area_m2 IS NOT NULL) AS area_m2, arg_min(height_m, pos) FILTER (height_m IS NOT NULL) AS height_m, count(*) AS members FROM c GROUP BY 1, 2""")
def merged_survivors(spark, sf):
    rows = S.spaces(spark, sf)
    return M.survivors(rows, _by_name(rows), ["number", "area_m2", "height_m"])


@query(f"""WITH {NAMED}, v AS (SELECT project_id, leader, pos, usage AS file, 'area_m2' AS field, area_m2 AS value FROM c UNION ALL
    SELECT project_id, leader, pos, usage, 'height_m', height_m FROM c),
  k AS (SELECT project_id, leader, field, arg_min(value, pos) AS kept, arg_min(file, pos) AS old_file FROM v WHERE value IS NOT NULL GROUP BY ALL)
  SELECT v.project_id, v.leader AS pos, v.field, any_value(kept) AS old, arg_max(value, v.pos) AS new, any_value(old_file) AS old_file, arg_max(file, v.pos) AS new_file
  FROM v JOIN k USING (project_id, leader, field) WHERE value IS NOT NULL AND abs(value - kept) > 0.01 GROUP BY v.project_id, v.leader, v.field""")
def merge_conflicts(spark, sf):
    rows = S.spaces(spark, sf)
    return M.conflicts(rows, _by_name(rows), ["area_m2", "height_m"]).select(
        "project_id", "pos", "field", "old", "new", F.col("old_sources")[0]["file"].alias("old_file"), F.col("new_sources")[0]["file"].alias("new_file"))


@query(f"""WITH {NAMED} SELECT project_id, leader AS pos, pos AS member_pos, 0 AS source_idx, usage AS file, pos % 7 AS file_id FROM c""")
def merge_lineage(spark, sf):
    rows = S.spaces(spark, sf)
    return M.lineage(rows, _by_name(rows)).select(
        "project_id", "pos", "member_pos", F.col("source_idx").cast("long").alias("source_idx"), "source.file", "source.file_id")


@query(f"""WITH {NAMED} SELECT DISTINCT project_id, leader AS pos, unnest(system_ids) AS linked_id FROM c""")
def merge_links(spark, sf):
    rows = S.spaces(spark, sf)
    return M.links(rows, _by_name(rows), "system_ids")


@query(f"""WITH {S.spaces_sql()}, a AS (SELECT * FROM spaces WHERE pos % 2 = 0), t AS (SELECT project_id, max(pos) + 1 AS base FROM a GROUP BY 1)
  SELECT project_id, id, pos FROM a UNION ALL
  SELECT s.project_id, s.id, row_number() OVER (PARTITION BY s.project_id ORDER BY s.pos % 7, s.pos) - 1 + coalesce(base, 0)
  FROM spaces s LEFT JOIN t USING (project_id) WHERE s.pos % 2 = 1""")
def arrival_order(spark, sf):
    """Rows of a batch come after those of the active model, file by file."""
    rows = S.spaces(spark, sf).select("project_id", "id", "pos")
    batch = rows.filter("pos % 2 = 1").withColumn("file_id", (F.col("pos") % 7) * F.lit(1 << 58))
    return M.in_arrival_order(rows.filter("pos % 2 = 0"), batch).select("project_id", "id", "pos")


# --- by ratio: SQL only where no two different names are near; brute force in the tests -----------


@query()
def space_clusters(spark, sf):
    return M.space_clusters(S.spaces(spark, sf))


@query()
def system_clusters(spark, sf):
    return M.system_clusters(S.systems(spark, sf, projects=2))


@query(f"""WITH {S.equipment_sql(25)}, n AS (SELECT project_id, pos, min(kind || ' ' || file) AS name FROM equipment GROUP BY 1, 2)
  SELECT project_id, pos, min(pos) OVER (PARTITION BY project_id, name) AS leader FROM n""")
def equipment_clusters(spark, sf):
    """Names are a flag and a status. Two names of one kind share 4 of 6 characters, a ratio of 0.67, so only equal ones merge."""
    # the line number is not unique, a position has to be
    rows = S.equipment(spark, sf, 25).groupBy("project_id", "pos").agg(F.min("id").alias("id"), F.min("name").alias("name"))
    return M.equipment_clusters(rows.withColumns({"kind": F.left("name", F.lit(1)), "guid": F.lit(None).cast("string")}))


@query(f"""WITH {S.MILESTONES} SELECT project_id, pos, min(pos) OVER (PARTITION BY project_id, text, due) AS leader FROM milestones""")
def milestone_clusters(spark, sf):
    """Texts are the five order priorities, none of which is near another, so only equal ones of one date merge."""
    return M.milestone_clusters(S.milestones(spark, sf))


@query()
def merged_spaces(spark, sf):
    """The whole merge of spaces: survivors with the number of conflicts and sources."""
    out = M.merge_entities("spaces", S.spaces(spark, sf))
    key = ["project_id", "pos"]
    return (
        out["merged"].drop("sources").join(out["conflicts"].groupBy(*key).agg(F.count(F.lit(1)).alias("conflicts")), key, "left")
        .join(out["lineage"].groupBy(*key).agg(F.count(F.lit(1)).alias("sources")), key, "left")
        .select(*key, "id", "name", "area_m2", "members", F.coalesce("conflicts", F.lit(0)).alias("conflicts"), "sources")
    )


@query(f"""WITH {NAMED}, f AS (SELECT project_id, leader AS pos, arg_min(system_ids, pos) FILTER (system_ids IS NOT NULL) AS ids FROM c GROUP BY 1, 2)
  SELECT project_id, pos, unnest(ids) AS system_id FROM f""")
def links_kept_by_merge(spark, sf):
    """The link lists of spaces survive the merge: the first list that is not null."""
    rows = S.spaces(spark, sf)
    return M.survivors(rows, _by_name(rows), M.SURVIVING["spaces"]).select("project_id", "pos", F.explode("system_ids").alias("system_id"))


@query()
def similar_names(spark, sf):
    """Per name of the odd parts the earliest even part with a similar name."""
    rows = S.spaces(spark, sf).select("project_id", "name", "pos")
    return Sim.earliest_similar(rows.filter("pos % 2 = 1"), rows.filter("pos % 2 = 0"), ["project_id"], "name", "pos", 0.8)


GREEDY = """
  u AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) AS i FROM (SELECT file_id, arg_min(pos, pos) AS pos, q FROM quotes GROUP BY file_id, q)),
  w AS (SELECT file_id, pos, i, list_distinct([x FOR x IN string_split_regex(q, '\\s+') IF x <> '']) AS words FROM u),
  r(file_id, i, kept, words_kept, is_new) AS (
    SELECT file_id, i, [pos], [words], true FROM w WHERE i = 1
    UNION ALL
    SELECT w.file_id, w.i,
      CASE WHEN d.dup THEN r.kept ELSE list_append(r.kept, w.pos) END,
      CASE WHEN d.dup THEN r.words_kept ELSE list_append(r.words_kept, w.words) END, NOT d.dup
    FROM r JOIN w ON w.file_id = r.file_id AND w.i = r.i + 1, LATERAL (SELECT coalesce(list_max(list_transform(r.words_kept, lambda k:
      CASE WHEN len(k) > 0 AND len(w.words) > 0 THEN len(list_intersect(k, w.words))::DOUBLE / greatest(len(k), len(w.words)) ELSE 0.0::DOUBLE END)), 0) > 0.8 AS dup) d)"""


@query(f"""WITH RECURSIVE {S.LINES}, quotes AS (SELECT file_id, para_idx AS pos, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS q FROM lines), {GREEDY}
  SELECT w.file_id, w.pos, row_number() OVER (PARTITION BY w.file_id ORDER BY w.pos) AS number FROM w JOIN r ON w.file_id = r.file_id AND w.i = r.i WHERE r.is_new""")
def distinct_findings(spark, sf):
    """Near copies among the lines of each document: exact, then by shared words with a kept line."""
    from plumbline.plans.review import distinct_findings as distinct
    rows = S.lines(spark, sf).select("file_id", F.col("para_idx").cast("long").alias("pos"), F.col("text").alias("quote"))
    return distinct(rows, ["file_id"]).select("file_id", "pos", "number")


@query()
def distinct_documents(spark, sf):
    """Near copies among whole documents of one language. Brute force in the tests."""
    from plumbline.plans.review import distinct_findings as distinct
    rows = S.read(spark, sf, "documents").select("lang", F.col("doc_id").alias("pos"), F.col("text").alias("quote"))
    return distinct(rows, ["lang"]).select("lang", "pos", "number")
