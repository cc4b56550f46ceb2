"""Queries on candidates, evidence and clusters, with SQL that finds them by plain joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields
from ..operators import blocking, dedup, match
from ..schema import RECORDS_SQL
from ..tables import written
from .registry import NORM_SQL, query, records_of


def ascii_(pattern: str) -> str:
    """A pattern for DuckDB's engine, which knows ASCII classes only; it is used on texts whose other letters are z."""
    return pattern.replace("(?iU)", "(?i)").replace("'", "''")


def plain(column: str) -> str:
    return f"regexp_replace({column}, '[^ -~]', 'z', 'g')"


#: Facts of records, as ``match.facts`` and ``blocking.with_norms`` give them.
def facts_sql(source: str, authors: bool = True) -> str:
    author = NORM_SQL.format("split_part(coalesce(authors[1], ''), ',', 1)") if authors else "''"
    return f"""facts AS (SELECT *, {NORM_SQL.format("title")} AS t, substr({NORM_SQL.format("journal")}, 1, 24) AS nj, substr({author}, 1, 12) AS ak, split_part(pages, '-', 1) AS page,
  regexp_matches(pages, '^1-([2-9]|[0-9]{{2,3}})$') AS unreadable, regexp_matches({plain("title")}, '{ascii_(fields.IDENTIFIER_TITLE)}') AS no_title, regexp_matches({plain("journal")}, '{ascii_(fields.CONFERENCE)}') AS venue,
  list_sort(list_distinct(list_transform(regexp_extract_all({plain("title")}, '{ascii_(fields.PERIOD_MARKER)}'), lambda x: lower(x)))) AS markers FROM {source})"""


def candidates_sql(source: str = "facts") -> str:
    """Pairs by the rarest tokens, by couples of them where these give none, and by composite keys."""
    return f"""tok AS (SELECT * FROM (SELECT DISTINCT ord, unnest(string_split(t, ' ')) AS token FROM {source}) WHERE length(token) > 2),
ranked AS (SELECT * FROM (SELECT ord, token, df, row_number() OVER (PARTITION BY ord ORDER BY df, token) AS rk FROM (SELECT *, count(*) OVER (PARTITION BY token) AS df FROM tok)) WHERE rk <= 4),
couples AS (SELECT *, count(*) OVER (PARTITION BY c) AS n FROM (SELECT a.ord, a.token || ' ' || b.token AS c FROM ranked a JOIN ranked b ON a.ord = b.ord AND a.rk < b.rk)),
held AS (SELECT ord, k, v, count(*) OVER (PARTITION BY k, v) AS n FROM (
  SELECT ord, 1 AS k, t || '|' || page AS v FROM {source} WHERE t <> '' AND page <> '' UNION ALL SELECT ord, 2, t || '|' || ak FROM {source} WHERE t <> '' AND ak <> ''
  UNION ALL SELECT ord, 3, ak || '|' || year || '|' || page FROM {source} WHERE ak <> '' AND year IS NOT NULL AND page <> '' UNION ALL SELECT ord, 4, nj || '|' || volume || '|' || page FROM {source} WHERE nj <> '' AND volume <> '' AND page <> ''
  UNION ALL SELECT ord, 5, ak || '|' || year || '|' || substr(t, 1, 18) FROM {source} WHERE ak <> '' AND year IS NOT NULL AND length(t) >= 18)),
found AS (SELECT a.ord AS x, b.ord AS y, false AS r FROM ranked a JOIN tok b USING (token) WHERE a.df <= 400
  UNION ALL SELECT a.ord, b.ord, false FROM couples a JOIN couples b USING (c) WHERE a.n <= 400 AND a.ord NOT IN (SELECT ord FROM ranked WHERE df > 1 AND df <= 400)
  UNION ALL SELECT a.ord, b.ord, true FROM held a JOIN held b USING (k, v) WHERE a.n <= 25),
candidates AS (SELECT least(x, y) AS i, greatest(x, y) AS j, bool_or(r) AS via_round, bool_or(NOT r) AS by_token FROM found WHERE x <> y GROUP BY 1, 2)"""


_NEAR = "coalesce(abs(a.year - b.year) <= 1, true)"
_CONFLICT = "CASE WHEN a.doi <> '' AND b.doi <> '' AND a.doi <> b.doi THEN 'doi' WHEN a.pmid <> '' AND b.pmid <> '' AND a.pmid <> b.pmid THEN 'pmid' ELSE '' END"
_PLACE = "CASE WHEN NOT a.unreadable AND NOT b.unreadable AND a.page <> '' AND b.page <> '' AND a.page <> b.page THEN 'pages' WHEN a.volume <> b.volume AND coalesce(a.year <> b.year, false) THEN 'volume+year' WHEN a.markers <> b.markers THEN 'series instalment' ELSE '' END"
_MEETING = "((a.venue AND a.doi = '' AND a.page = '' AND b.doi <> '' AND b.page <> '') OR (b.venue AND b.doi = '' AND b.page = '' AND a.doi <> '' AND a.page <> ''))"
_SPOT = "coalesce(a.year = b.year, false) AND a.page <> '' AND a.page = b.page"


@query(f", {facts_sql('records')}, {candidates_sql()} SELECT * FROM candidates")
def candidate_pairs(spark, sf_dir):
    normed = blocking.with_norms(records_of(spark, sf_dir)).drop("abstract", "raw", "provenance")
    return blocking.candidates(written(normed))


@query(f""", {facts_sql('records')}, {candidates_sql()}
SELECT i, j, length(a.t) > 0 AND length(b.t) > 0 AND CAST(2 * least(length(a.t), length(b.t)) AS DOUBLE) / (length(a.t) + length(b.t)) >= CASE WHEN via_round THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.93 AS DOUBLE) END AS length_ok,
  {_NEAR} AS years_ok, {_CONFLICT} AS conflict, {_PLACE} AS separated_by, {_MEETING} AS conference FROM candidates JOIN facts a ON a.ord = i JOIN facts b ON b.ord = j""")
def pair_guards(spark, sf_dir):
    # normalised once, as in deduplication; candidates read it several times
    r = blocking.with_norms(records_of(spark, sf_dir)).withColumn("rich", fields.richness())
    r = written(r.select("ord", "title", "authors", "year", "pages", "volume", "journal", *match.IDS, "norm_title", "norm_journal", "author_key", "rich"))
    return match.pair_guards(blocking.candidates(r), match.facts(r), match.Options()).drop("via_round")


def _reached(name: str, edges: str) -> str:
    """The smallest record that each one reaches over ``edges`` (x, y)."""
    return f"""{name}_reach(n, m) AS (SELECT ord, ord FROM facts UNION SELECT r.n, e.y FROM {name}_reach r JOIN (SELECT x, y FROM {edges} UNION ALL SELECT y, x FROM {edges}) e ON e.x = r.m),
{name} AS (SELECT n AS ord, min(m) AS root FROM {name}_reach GROUP BY n)"""


@query(f"""WITH RECURSIVE {RECORDS_SQL}, {facts_sql('records', authors=False)},
ids AS (SELECT ord, 'doi' AS kind, doi AS value FROM records WHERE doi <> '' UNION ALL SELECT ord, 'pmid', pmid FROM records WHERE pmid <> ''),
stars AS (SELECT ord, min(ord) OVER (PARTITION BY kind, value) AS owner, count(*) OVER (PARTITION BY kind, value) AS members FROM ids),
links AS (SELECT s.owner AS x, s.ord AS y FROM stars s JOIN facts a ON a.ord = s.owner JOIN facts b ON b.ord = s.ord WHERE s.ord <> s.owner AND (members < 3 OR ({_PLACE} = '' AND NOT {_MEETING}))),
{_reached('first', 'links')},
reps AS (SELECT * FROM facts WHERE ord IN (SELECT root FROM first)),
{candidates_sql('reps')},
same AS (SELECT i AS x, j AS y FROM candidates JOIN reps a ON a.ord = i JOIN reps b ON b.ord = j
  WHERE a.t = b.t AND a.t <> '' AND NOT a.no_title AND NOT b.no_title AND {_NEAR} AND {_PLACE} = '' AND NOT {_MEETING} AND ({_CONFLICT} = '' OR ({_SPOT}))),
{_reached('second', 'same')}
SELECT f.ord, min(f.ord) OVER (PARTITION BY s.root) AS cluster FROM first f JOIN second s ON s.ord = f.root""", records=False)
def dedup_pairwise_clusters(spark, sf_dir):
    """Both stages of deduplication, each link and pair judged by itself, where only equal titles are alike and authors
    aren't known: what SQL can say of it."""
    r = records_of(spark, sf_dir).withColumn("authors", F.array().cast("array<string>"))
    return dedup.deduplicate(r, mode="pairwise", fuzzy_threshold=1.0, round_title_min=1.0, id_title_min=0.0).clusters
