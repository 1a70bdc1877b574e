"""One query for each operator over the driver's tables, and the SQL that says what it must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import domains as D
from colloquy.functions import text as X
from colloquy.operators import compare as C
from colloquy.operators import evaluate as E
from colloquy.operators import graph as G
from colloquy.operators import records as R
from colloquy.operators import sessionize as S
from colloquy.operators import vocabulary as V
from colloquy.operators.filters import Selection, clean_demographics, dimension_counts, in_segment, select_edges, select_stances, with_group
from colloquy.plans import run, viewer
from colloquy.plans.models import WordPairs, answers, assigned_names
from colloquy.plans.pipeline import prompts
from colloquy.sources import files
from colloquy.sources import fixtures as X_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

A, B = "AUTOMOBILE", "BUILDING"
SALT, GAP = "discussion", 12 * 3600 * 1_000_000
PICK = Selection(entity_type="policy", min_confidence=0.3, show_inferred=False, segment={"sex": "F", "age_group": "30-44"})
SEG_A, SEG_B = Selection(segment={"political_affiliation": A}), Selection(segment={"political_affiliation": B, "sex": "M"})

_CTE = {"e": X_.EDGES, "s": X_.STANCES, "d": X_.DEMOGRAPHICS, "r": X_.REGISTRY, "seg": X_.SEGMENTS, "t": X_.TURNS, "v": X_.VECTORS}


def _sql(names: str, body: str) -> str:
    """body with the named fixtures as common table expressions."""
    parts = [f"{n} AS ({X_.sql_text(_CTE[n])})" for n in names.split()]
    return f"WITH {', '.join(parts)}{',' if body.lstrip().startswith(',,') else ''} {body.lstrip().removeprefix(',,')}"


class Tables:
    """The fixtures of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return X_.frame(self.spark, self.dir, _CTE[name])

    @property
    def store(self) -> viewer.Store:
        return viewer.Store(self.e, self.s, self.r, self.d)

    @property
    def turns(self) -> DataFrame:
        return self.t

    @property
    def mentions(self) -> DataFrame:
        return V.label_mentions(self.e, self.s)

    @property
    def vocab(self) -> DataFrame:
        """Every fourth concept by label, with the next concept as an alias; the one after that is near by its vector, and
        the last of four is unknown."""
        k = F.split_part("node_id", F.lit(" "), F.lit(2)).cast("int")
        return self.r.where(k % 4 == 0).select(F.col("node_id").alias("concept_id"), "label", "type", F.array(F.concat(F.lit("Concept  "), (k + 1).cast("string"))).alias("aliases"), k.alias("ord"), F.lit(7).cast("long").alias("mention_count"))

    @property
    def similar(self) -> DataFrame:
        """(norm, concept_id): what the vectors of mentions without an exact match are near to."""
        m = V.exact_matches(V.collected_mentions(self.mentions), self.vocab).where("method is null")
        m = m.select(F.col("norm").alias("key"), F.lit("any").alias("type"), _angle(F.split_part("norm", F.lit(" "), F.lit(2)).cast("int")).alias("embedding"))
        v = self.vocab.select(F.col("concept_id").alias("concept"), F.lit("any").alias("type"), _angle(F.col("ord")).alias("embedding"), "ord")
        return V.nearest(m, v, 0.99).where("grounded").select(F.col("key").alias("norm"), F.col("concept").alias("concept_id"))

    @property
    def report(self) -> DataFrame:
        return V.grounded(V.collected_mentions(self.mentions), self.vocab, self.similar)


def _angle(k):
    """A unit vector for each concept: groups of four lie 0.3 apart; the third is 0.05 and the last 0.15 off the first."""
    a = F.floor(k / 4) * 0.3 + F.element_at(F.array(*map(F.lit, (0.0, 0.0, 0.05, 0.15))), (k % 4 + 1).cast("int"))
    return F.array(F.cos(a), F.sin(a))


def query(sql: str | None = None, fixtures: str = ""):
    def register(f: Callable[[Tables], DataFrame]):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = _sql(fixtures, sql) if fixtures else sql
        return f

    return register


SIGN = "CASE polarity WHEN 'supports' THEN 1 WHEN 'opposes' THEN -1 ELSE 0 END"
NORM = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
MEAN_CONF = "CAST(sum(CAST(round(confidence * 1000000) AS BIGINT)) AS DOUBLE) / count(confidence) / 1000000"
MEAN_SIGN = f"CAST(sum({SIGN}) AS DOUBLE) / count(*)"
KEYS = "source_node_id, target_node_id, relation"


# ---- fixtures, labels, ids


@query("SELECT * FROM e", "e")
def edges_fixture(t):
    return t.e


@query("SELECT * FROM s", "s")
def stances_fixture(t):
    return t.s


@query("SELECT * FROM d", "d")
def demographics_fixture(t):
    return t.d


@query(f"SELECT DISTINCT source_label, {NORM.format('source_label')} AS norm, 'concept_' || substr(sha256({NORM.format('source_label')}), 1, 12) AS concept_id FROM e", "e")
def label_norm_ids(t):
    return t.e.select("source_label", X.normal(F.col("source_label")).alias("norm"), X.hashed_id(F.col("source_label")).alias("concept_id")).distinct()


@query(f"SELECT DISTINCT speaker, 'Speaker_' || substr(sha256('{SALT}:' || speaker), 1, 8) AS pseudonym FROM t", "t")
def pseudonyms(t):
    out = S.pseudonymised(t.turns, SALT, keep_original=True)
    return out.select(F.col("speaker_original").alias("speaker"), F.col("speaker").alias("pseudonym")).distinct()


@query(f"SELECT polarity, {SIGN} AS sign, count(*) AS n FROM e GROUP BY polarity", "e")
def polarity_signs(t):
    return t.e.groupBy("polarity").agg(F.count(F.lit(1)).alias("n")).select("polarity", X.polarity_sign(F.col("polarity")).alias("sign"), "n")


@query("SELECT label, CASE WHEN length(label) > 22 THEN substr(label, 1, 20) || '...' ELSE label END AS short FROM (SELECT DISTINCT concat_ws(' ', source_label, relation, target_label) AS label FROM e)", "e")
def short_labels(t):
    return t.e.select(F.concat_ws(" ", "source_label", "relation", "target_label").alias("label")).distinct().select("label", X.short_label(F.col("label")).alias("short"))


# ---- aggregation

_SHARES = ", ".join(f"CAST(count(*) FILTER ({c} = '{v}') AS DOUBLE) / count(*) AS {c}_{v}" for c, vs in (("stance", D.STANCES), ("explicitness", D.EXPLICITNESS), ("polarity", D.POLARITIES)) for v in vs)


@query(f"SELECT {KEYS}, count(*) AS mention_count, count(DISTINCT participant_id) AS unique_speakers, count(DISTINCT table_id) AS unique_tables, count(DISTINCT round_id) AS unique_rounds, {_SHARES}, {MEAN_SIGN} AS mean_polarity, {MEAN_CONF} AS mean_confidence FROM e GROUP BY {KEYS}", "e")
def edge_aggregate(t):
    return G.aggregate_edges(t.e)


@query(f",, l AS (SELECT {KEYS}, 'stance' AS dimension, stance AS value FROM e UNION ALL SELECT {KEYS}, 'explicitness', explicitness FROM e UNION ALL SELECT {KEYS}, 'polarity', polarity FROM e) SELECT {KEYS}, dimension, value, count(*) AS mentions, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY {KEYS}, dimension) AS share FROM l GROUP BY {KEYS}, dimension, value", "e")
def edge_distributions(t):
    return G.edge_distributions(t.e)


_WEIGHTS = "SELECT r.node_id, r.label, r.type, count(m.id) AS weight FROM r LEFT JOIN ({}) m ON m.id = r.node_id GROUP BY r.node_id, r.label, r.type"
_ENDS = "SELECT source_node_id AS id FROM e UNION ALL SELECT target_node_id FROM e"


@query(_WEIGHTS.format(_ENDS), "e r")
def node_weights(t):
    return G.node_weights(t.e, t.r)


@query(_WEIGHTS.format(_ENDS + " UNION ALL SELECT concept_node_id FROM s"), "e s r")
def viewer_node_weight(t):
    return G.node_weights(t.e, t.r, t.s)


@query(f"SELECT concept_node_id, count(*) AS stance_count, count(DISTINCT participant_id) AS unique_speakers, " + ", ".join(f"CAST(count(*) FILTER (polarity = '{p}') AS DOUBLE) / count(*) AS polarity_{p}" for p in D.POLARITIES) + f", {MEAN_SIGN} AS mean_polarity FROM s WHERE concept_node_id IS NOT NULL GROUP BY concept_node_id", "s")
def stance_summary(t):
    return G.aggregate_stances(t.s)


@query(f"SELECT {KEYS}, rank, evidence_text FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY edge_id) AS rank FROM e) WHERE rank <= 5", "e")
def evidence_samples(t):
    return G.evidence_samples(t.e)


@query(f"SELECT {KEYS}, string_agg(DISTINCT participant_id, ',' ORDER BY participant_id) AS speakers FROM e GROUP BY {KEYS}", "e")
def edge_speakers(t):
    return G.edge_speakers(t.e).select(*G.TRIPLE, F.array_join("speaker_ids", ",").alias("speakers"))


# ---- filters and segments

_AGE = "TRY_CAST(nullif(regexp_extract(age, '^\\s*([+-]?\\d+)', 1), '') AS BIGINT)"
_CLEAN = f"""SELECT participant_id, CASE WHEN political_affiliation NOT IN ('CONSENT_REVOKED', 'DATA_EXPIRED', '', 'Unknown', 'nan') THEN political_affiliation END AS political_affiliation,
 CASE WHEN {_AGE} < 30 THEN '18-29' WHEN {_AGE} < 45 THEN '30-44' WHEN {_AGE} < 60 THEN '45-59' WHEN {_AGE} IS NOT NULL THEN '60+' END AS age_group,
 CASE WHEN sex NOT IN ('CONSENT_REVOKED', 'DATA_EXPIRED', '', 'Unknown', 'nan') THEN sex END AS sex, ethnicity FROM d"""


@query(_CLEAN, "d")
def age_bins(t):
    return clean_demographics(t.d)


_PICK_WHO = f",, c AS ({_CLEAN}), w AS (SELECT participant_id FROM c WHERE sex = 'F' AND age_group = '30-44'), n AS (SELECT node_id FROM r WHERE type = 'policy')"


@query(_PICK_WHO + " SELECT e.* FROM e WHERE confidence >= 0.3 AND explicitness <> 'inferred' AND participant_id IN (SELECT participant_id FROM w) AND (coalesce(source_node_id IN (SELECT node_id FROM n), false) OR target_node_id IN (SELECT node_id FROM n))", "e r d")
def filtered_edges(t):
    return select_edges(t.e, t.r, t.d, PICK)


@query(_PICK_WHO + " SELECT s.* FROM s WHERE confidence >= 0.3 AND explicitness <> 'inferred' AND participant_id IN (SELECT participant_id FROM w) AND concept_node_id IN (SELECT node_id FROM n)", "s r d")
def filtered_stances(t):
    return select_stances(t.s, t.r, t.d, PICK)


_IN_A = "participant_id IN (SELECT participant_id FROM c WHERE political_affiliation = 'AUTOMOBILE')"
_IN_B = "participant_id IN (SELECT participant_id FROM c WHERE political_affiliation = 'BUILDING' AND sex = 'M')"
_SEGS = f",, c AS ({_CLEAN}), ea AS (SELECT * FROM e WHERE {_IN_A}), eb AS (SELECT * FROM e WHERE {_IN_B})"
_SEGS2 = _SEGS + f", sa AS (SELECT * FROM s WHERE {_IN_A}), sb AS (SELECT * FROM s WHERE {_IN_B})"


@query(_SEGS + " SELECT edge_id, participant_id FROM eb", "e d")
def segment_edges(t):
    return in_segment(t.e, t.d, SEG_B.segment).select("edge_id", "participant_id")


@query("SELECT edge_id, relation FROM e WHERE stance = 'asserted' AND table_id = 'NATION_3'", "e")
def table_stance_filter(t):
    return select_edges(t.e, t.r, t.d, Selection(table_id="NATION_3", stance="asserted")).select("edge_id", "relation")


@query(f",, c AS ({_CLEAN}), p AS (SELECT * FROM c WHERE participant_id IN (SELECT participant_id FROM e)), l AS (SELECT 'political_affiliation' AS dimension, political_affiliation AS value FROM p UNION ALL SELECT 'age_group', age_group FROM p UNION ALL SELECT 'sex', sex FROM p UNION ALL SELECT 'ethnicity', ethnicity FROM p) SELECT dimension, value, count(*) AS participants FROM l WHERE value IS NOT NULL GROUP BY dimension, value", "e d")
def dimension_counts_query(t):
    return dimension_counts(t.e, t.d)


@query("SELECT type, count(*) AS nodes FROM r GROUP BY type", "r")
def type_counts(t):
    return t.r.groupBy("type").agg(F.count(F.lit(1)).alias("nodes"))


@query("SELECT coalesce(political_affiliation, 'Unknown') AS \"group\", count(*) AS n FROM e LEFT JOIN d USING (participant_id) GROUP BY 1", "e d")
def participant_groups(t):
    return with_group(t.e, t.d).groupBy("group").agg(F.count(F.lit(1)).alias("n"))


# ---- comparison

_GROUPED = ",, ge AS (SELECT e.*, coalesce(political_affiliation, 'Unknown') AS grp FROM e LEFT JOIN d USING (participant_id)), gs AS (SELECT s.*, coalesce(political_affiliation, 'Unknown') AS grp FROM s LEFT JOIN d USING (participant_id))"
_POOL = _GROUPED + f", p AS (SELECT grp, source_node_id AS id, {SIGN} AS sign FROM ge UNION ALL SELECT grp, target_node_id, {SIGN} FROM ge UNION ALL SELECT grp, concept_node_id, {SIGN} FROM gs), m AS (SELECT id AS node_id, coalesce(avg(sign) FILTER (grp = 'AUTOMOBILE'), 0) AS mean_polarity_a, coalesce(avg(sign) FILTER (grp = 'BUILDING'), 0) AS mean_polarity_b, count(*) FILTER (grp = 'AUTOMOBILE') AS n_a, count(*) FILTER (grp = 'BUILDING') AS n_b FROM p WHERE id IS NOT NULL AND grp IN ('AUTOMOBILE', 'BUILDING') GROUP BY id)"


@query(_GROUPED + " SELECT DISTINCT grp AS \"group\" FROM ge UNION SELECT grp FROM gs WHERE grp <> 'Unknown'", "e s d")
def available_groups(t):
    return C.available_groups(t.e, t.s, t.d)


@query(_POOL + " SELECT *, abs(mean_polarity_a - mean_polarity_b) AS divergence FROM m", "e s d")
def concept_divergence(t):
    return C.concept_divergence(t.e, t.s, t.d, A, B)


@query(_POOL + " SELECT *, abs(mean_polarity_a - mean_polarity_b) AS divergence FROM m ORDER BY divergence DESC, n_a + n_b DESC, node_id LIMIT 10", "e s d")
def top_divergence(t):
    return C.top_divergence(C.concept_divergence(t.e, t.s, t.d, A, B), 10)


_PRESENCE = _GROUPED + f", q AS (SELECT {KEYS}, bool_or(grp = 'AUTOMOBILE') AS in_a, bool_or(grp = 'BUILDING') AS in_b FROM ge WHERE grp IN ('AUTOMOBILE', 'BUILDING') AND source_node_id IS NOT NULL AND target_node_id IS NOT NULL GROUP BY {KEYS})"


@query(_PRESENCE + " SELECT count(*) FILTER (in_a AND in_b) AS shared_triples, count(*) FILTER (in_a AND NOT in_b) AS only_a_triples, count(*) FILTER (in_b AND NOT in_a) AS only_b_triples, CAST(count(*) FILTER (in_a AND in_b) AS DOUBLE) / count(*) AS triple_jaccard FROM q", "e s d")
def triple_overlap(t):
    return C.triple_overlap(C.triple_presence(t.e, t.d, A, B))


@query(_PRESENCE + f" SELECT {KEYS}, CASE WHEN in_a THEN 'AUTOMOBILE' ELSE 'BUILDING' END AS only_in FROM q WHERE in_a <> in_b", "e s d")
def edge_divergence(t):
    return C.edge_divergence(C.triple_presence(t.e, t.d, A, B), A, B, None)


@query(_PRESENCE + f" SELECT {KEYS}, CASE WHEN in_a THEN 'AUTOMOBILE' ELSE 'BUILDING' END AS only_in FROM q WHERE in_a <> in_b ORDER BY in_a DESC, source_node_id, target_node_id, relation LIMIT 40", "e s d")
def edge_divergence_top(t):
    return C.edge_divergence(C.triple_presence(t.e, t.d, A, B), A, B)


# ---- viewer

_VIEW = f"SELECT {KEYS}, count(*) AS mention_count, count(DISTINCT participant_id) AS unique_speakers, {MEAN_CONF} AS mean_confidence, {MEAN_SIGN} AS mean_polarity, bool_or(explicitness IN ('inferred', 'near_explicit')) AS has_inferred FROM {{}} GROUP BY {KEYS}"
_DEGREE = "SELECT node_id, count(DISTINCT other) AS degree FROM (SELECT source_node_id AS node_id, target_node_id AS other FROM {0} WHERE source_node_id IS NOT NULL AND target_node_id IS NOT NULL UNION ALL SELECT target_node_id, source_node_id FROM {0} WHERE source_node_id IS NOT NULL AND target_node_id IS NOT NULL) GROUP BY node_id"
_POLARITY = f"SELECT node_id, CAST(sum(sign) AS DOUBLE) / count(*) AS mean_polarity, count(*) AS mentions FROM (SELECT source_node_id AS node_id, {SIGN} AS sign FROM {{0}} UNION ALL SELECT target_node_id, {SIGN} FROM {{0}} UNION ALL SELECT concept_node_id, {SIGN} FROM {{1}}) WHERE node_id IS NOT NULL GROUP BY node_id"


@query(_VIEW.format("e"), "e")
def viewer_edge_aggregate(t):
    return G.viewer_edges(t.e)


@query(_POLARITY.format("e", "s"), "e s")
def node_polarity(t):
    return G.node_polarity(t.e, t.s)


@query(_DEGREE.format("e"), "e")
def degree(t):
    return G.degrees(G.viewer_edges(t.e))


@query(_SEGS + f", a AS ({_VIEW.format('ea')}), b AS ({_VIEW.format('eb')}) SELECT coalesce(a.source_node_id, b.source_node_id) AS source_node_id, coalesce(a.target_node_id, b.target_node_id) AS target_node_id, coalesce(a.relation, b.relation) AS relation, coalesce(a.mention_count, 0) + coalesce(b.mention_count, 0) AS mention_count, coalesce(a.unique_speakers, 0) + coalesce(b.unique_speakers, 0) AS unique_speakers, coalesce(a.mean_confidence, b.mean_confidence) AS mean_confidence, coalesce(a.mean_polarity, b.mean_polarity) AS mean_polarity, coalesce(a.has_inferred, b.has_inferred) AS has_inferred, CASE WHEN a.relation IS NOT NULL AND b.relation IS NOT NULL THEN 'both' WHEN a.relation IS NOT NULL THEN 'a' ELSE 'b' END AS presence FROM a FULL JOIN b ON a.source_node_id IS NOT DISTINCT FROM b.source_node_id AND a.target_node_id IS NOT DISTINCT FROM b.target_node_id AND a.relation = b.relation", "e d")
def compare_links(t):
    return C.compare_links(t.store.compared(SEG_A, SEG_B)[0])


_POL2 = _SEGS2 + f", a AS ({_POLARITY.format('ea', 'sa')}), b AS ({_POLARITY.format('eb', 'sb')}), j AS (SELECT node_id, coalesce(a.mean_polarity, 0) AS polarity_a, coalesce(b.mean_polarity, 0) AS polarity_b, abs(coalesce(a.mean_polarity, 0) - coalesce(b.mean_polarity, 0)) AS divergence FROM a FULL JOIN b USING (node_id))"


@query(_POL2 + " SELECT * FROM j", "e s d")
def polarity_divergence(t):
    return C.polarity_divergence(*t.store.compared(SEG_A, SEG_B))


@query(_POL2 + " SELECT count(*) AS concepts, count(*) FILTER (divergence >= 0.5) AS diverging, count(*) FILTER (divergence >= 0.02) AS slightly FROM j", "e s d")
def diverging_concepts(t):
    return C.polarity_divergence(*t.store.compared(SEG_A, SEG_B)).agg(F.count(F.lit(1)).alias("concepts"), F.count_if(F.col("divergence") >= 0.5).alias("diverging"), F.count_if(F.col("divergence") >= 0.02).alias("slightly"))


@query(_SEGS + f", a AS ({_DEGREE.format('ea')}), b AS ({_DEGREE.format('eb')}) SELECT node_id, abs(coalesce(CAST(a.degree AS DOUBLE) / (SELECT greatest(max(degree), 1) FROM a), 0) - coalesce(CAST(b.degree AS DOUBLE) / (SELECT greatest(max(degree), 1) FROM b), 0)) AS score FROM a FULL JOIN b USING (node_id)", "e d")
def differential_centrality(t):
    return C.differential_centrality(t.store.compared(SEG_A, SEG_B)[0])


@query(f",, g AS ({_DEGREE.format('e')}) SELECT node_id, degree FROM g ORDER BY degree DESC, node_id LIMIT 15", "e")
def top_central(t):
    return G.top_central(G.degrees(t.e), G.node_weights(t.e, t.r), score="degree")


@query(f",, l AS ({_VIEW.format('e')}) SELECT *, 'outgoing' AS direction FROM l WHERE source_node_id = 'concept 3' UNION ALL SELECT *, 'incoming' FROM l WHERE target_node_id = 'concept 3'", "e")
def node_drilldown(t):
    return G.node_links(G.viewer_edges(t.e), "concept 3")


@query("SELECT edge_id, relation, evidence_text, speaker, coalesce(nullif(political_affiliation, ''), 'Unknown') AS affiliation, stance, polarity FROM e LEFT JOIN d USING (participant_id) WHERE source_node_id = 'concept 3' AND target_node_id = 'concept 5'", "e d")
def edge_drilldown(t):
    return G.edge_evidence(t.e, t.d, "concept 3", "concept 5")


@query(_SEGS + " SELECT 'edges' AS kind, count(*) AS total FROM e UNION ALL SELECT 'stances', count(*) FROM s UNION ALL SELECT 'nodes', count(*) FROM r UNION ALL SELECT 'visible', count(*) FROM ea", "e s r d")
def visible_stats(t):
    return viewer.visible(t.e, t.s, t.r, t.store.picked(SEG_A)[0])


@query(f",, l AS ({_VIEW.format('e')}) SELECT {KEYS}, least(greatest(CAST(mention_count AS DOUBLE), 2), 7) AS width_by_count, least(greatest(unique_speakers * 1.5::DOUBLE, 1), 6) AS width_by_speakers, mean_confidence * 0.65::DOUBLE + 0.35::DOUBLE AS opacity, has_inferred AS dashed FROM l", "e")
def link_encoding(t):
    weights = G.node_weights(t.e, t.r, t.s)
    return G.visual_encoding(G.viewer_edges(t.e), weights, G.top_central(G.degrees(t.e), weights, score="degree"))[0]


@query(f",, w AS ({_WEIGHTS.format(_ENDS + ' UNION ALL SELECT concept_node_id FROM s')}), g AS ({_DEGREE.format('e')}), c AS (SELECT node_id FROM g ORDER BY degree DESC, node_id LIMIT 15) SELECT node_id, weight, CASE WHEN weight > 0 THEN weight * 20::DOUBLE / (SELECT max(weight) FROM w) + 6 ELSE 4 END + CASE WHEN node_id IN (SELECT node_id FROM c) THEN 6 ELSE 0 END AS radius, node_id IN (SELECT node_id FROM c) AS central FROM w", "e s r")
def node_encoding(t):
    weights = G.node_weights(t.e, t.r, t.s)
    return G.visual_encoding(G.viewer_edges(t.e), weights, G.top_central(G.degrees(t.e), weights, score="degree"))[1]


@query(f",, p AS ({_POLARITY.format('e', 's')}) SELECT node_id, CASE WHEN mean_polarity > 0.15 THEN 'supports' WHEN mean_polarity < -0.15 THEN 'opposes' ELSE 'neutral' END AS position FROM p", "e s")
def polarity_labels(t):
    return G.node_polarity(t.e, t.s).select("node_id", F.regexp_extract(X.polarity_label(F.col("mean_polarity")), r"\((\w+)\)", 1).alias("position"))


_CHANNEL = "CAST(CAST(floor({0} + CASE WHEN m >= 0 THEN {1} - {0} ELSE {2} - {0} END * least(abs(m), 1) + 0.5) AS INT) AS VARCHAR)"


@query(f",, p AS ({_POLARITY.format('e', 's')}), q AS (SELECT node_id, mean_polarity * 7 AS m FROM p UNION ALL SELECT NULL, 0) SELECT node_id, 'rgb(' || " + " || ', ' || ".join(_CHANNEL.format(*c) for c in ((156, 22, 220), (163, 163, 38), (175, 74, 38))) + " || ')' AS colour FROM q", "e s")
def polarity_colours(t):
    """Means are drawn apart, so that some go beyond 1; a null mean is neutral."""
    p = G.node_polarity(t.e, t.s).select("node_id", F.col("mean_polarity") * 7)
    return p.union(t.spark.sql("SELECT CAST(NULL AS STRING), CAST(NULL AS DOUBLE)")).toDF("node_id", "m").select("node_id", X.polarity_colour(F.col("m")).alias("colour"))


@query(_WEIGHTS.format(_ENDS + " UNION ALL SELECT concept_node_id FROM s") + " HAVING count(m.id) > 0", "e s r")
def connected_nodes(t):
    return viewer.single_view(t.store, hide_isolated=True)["nodes"].select("node_id", "label", "type", "weight")


# ---- sessions and windows

_ISLANDS = f",, l AS (SELECT *, lag(speaker) OVER w AS ps, lag(end_time) OVER w AS pe, row_number() OVER w AS rn FROM seg WINDOW w AS (PARTITION BY table_id, round_id ORDER BY start_time, ord)), i AS (SELECT *, sum(CASE WHEN rn > 1 AND speaker IS NOT DISTINCT FROM ps AND start_time - pe <= {GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY table_id, round_id ORDER BY start_time, ord) AS island FROM l)"


@query(_ISLANDS + " SELECT table_id, round_id, any_value(speaker) AS speaker, string_agg(trim(transcript), ' ' ORDER BY start_time, ord) AS text, min(start_time) AS start_time, arg_max(end_time, ord + start_time * 1000000::HUGEINT) AS end_time, count(*) AS raw_segment_count FROM i GROUP BY table_id, round_id, island", "seg")
def utterances(t):
    return S.utterances(t.seg, GAP).select("table_id", "round_id", "speaker", "text", "start_time", "end_time", "raw_segment_count")


QUERIES["utterances_bucketed"] = lambda spark, sf_dir: S.utterances(Tables(spark, sf_dir).seg, GAP, bucket=7 * 24 * 3600 * 1_000_000).select("table_id", "round_id", "speaker", "text", "start_time", "end_time", "raw_segment_count")
ORACLE_SQL["utterances_bucketed"] = ORACLE_SQL["utterances"]


_TURN_ROWS = ",, p AS (SELECT *, row_number() OVER (PARTITION BY table_id, round_id ORDER BY start_time, turn_id) - 1 AS position, count(*) OVER (PARTITION BY table_id, round_id) AS n FROM t)"
_WINDOWS = _TURN_ROWS + ", w AS (SELECT p.*, k.k * 2 AS window_start FROM p JOIN range(0, 10000) k(k) ON k.k * 2 <= p.position AND p.position < k.k * 2 + 3)"
_WINDOW_TEXT = _WINDOWS + ", x AS (SELECT table_id, round_id, window_start, string_agg(text, ' ' ORDER BY position) AS window_text, string_agg('[' || speaker || ']: ' || text, chr(10) ORDER BY position) AS excerpt, string_agg(turn_id, ',' ORDER BY position) AS turn_ids, arg_min(speaker, position) AS speaker, arg_min(participant_id, position) AS participant_id FROM w GROUP BY table_id, round_id, window_start)"


@query(_WINDOWS + " SELECT turn_id, table_id, round_id, position, window_start FROM w", "t")
def turn_windows(t):
    return S.turn_windows(t.turns).select("turn_id", "table_id", "round_id", "position", "window_start")


@query(_WINDOW_TEXT + " SELECT * FROM x", "t")
def window_texts(t):
    return S.window_texts(S.turn_windows(t.turns)).withColumn("turn_ids", F.array_join("turn_ids", ","))


@query(_WINDOW_TEXT + " SELECT table_id, window_start, sha256('VOCABULARY' || chr(10) || 'none' || chr(10) || 'EXCERPT' || chr(10) || excerpt) AS prompt FROM x", "t")
def window_prompts(t):
    return prompts(S.window_texts(S.turn_windows(t.turns)), "none").select("table_id", "window_start", F.sha2(F.regexp_replace("prompt", r"(?s)\nAnswer with JSON of this schema alone:\n.*$", ""), 256).alias("prompt"))


_WORDS = "len(regexp_extract_all(text, '\\S+'))"


@query(f"SELECT table_id, count(*) AS turns FROM t WHERE {_WORDS} > 3 GROUP BY table_id ORDER BY turns DESC, min(start_time), min(struct_pack(a := start_time, b := turn_id)), table_id LIMIT 5", "t")
def busiest_tables(t):
    return S.busiest_tables(t.turns)


@query(f"SELECT turn_id, speaker, table_id, round_id, text FROM t WHERE {_WORDS} > 5 ORDER BY sha256('42:' || turn_id), turn_id LIMIT 120", "t")
def labelling_sample(t):
    return S.labelling_template(t.turns).drop("annotations")


# ---- extraction

_LINES = _WINDOW_TEXT + ", ln AS (SELECT x.*, unnest(string_split(window_text, chr(10))) AS line, generate_subscripts(string_split(window_text, chr(10)), 1) AS no FROM x), wd AS (SELECT *, regexp_extract_all(line, '\\S+') AS words FROM ln), ed AS (SELECT *, words[1] AS source_label, words[2] AS target_label, words[1] || ' ' || words[2] AS evidence_text, (length(line) % 101)::DOUBLE / 100 AS confidence, row_number() OVER (PARTITION BY table_id, round_id, window_start ORDER BY no) - 1 AS item FROM wd WHERE len(words) > 1)"


def _extracted(t, kind: str) -> DataFrame:
    w = R.extracted(answers(prompts(S.window_texts(S.turn_windows(t.turns)), "none"), WordPairs()))
    return w.select("table_id", "round_id", "window_start", "participant_id", "window_text", F.posexplode(kind).alias("item", "x")).select("table_id", "round_id", "window_start", "participant_id", "window_text", "item", "x.*")


@query(_LINES + f" SELECT table_id, window_start, item, source_label, target_label, confidence FROM ed WHERE contains({NORM.format('window_text')}, {NORM.format('evidence_text')})", "t")
def evidence_valid(t):
    return R.verified(_extracted(t, "edges")).select("table_id", "window_start", "item", "source_label", "target_label", "confidence")


@query(_LINES + " SELECT table_id, window_start, item, source_label, target_label FROM (SELECT *, row_number() OVER (PARTITION BY lower(source_label), lower(target_label), table_id, lower(evidence_text) ORDER BY window_start, item) AS k FROM ed) WHERE k = 1", "t")
def dedup_edges(t):
    return R.dedup_edges(_extracted(t, "edges"), ["window_start", "item"]).select("table_id", "window_start", "item", "source_label", "target_label")


@query(_LINES + " SELECT participant_id, source_label AS concept_label FROM (SELECT *, row_number() OVER (PARTITION BY lower(source_label), participant_id ORDER BY table_id, window_start, item) AS k FROM ed) WHERE k = 1", "t")
def dedup_stances(t):
    return R.dedup_stances(_extracted(t, "stances"), ["table_id", "window_start", "item"]).select("participant_id", "concept_label")


@query(f"SELECT edge_id, {KEYS}, speaker, participant_id, table_id, round_id, evidence_text, stance, polarity, {SIGN} AS polarity_sign, explicitness, confidence FROM e", "e")
def raw_edges(t):
    return R.raw_edges(t.e)


@query(f"SELECT stance_id, concept_node_id, concept_label, concept_type, polarity, {SIGN} AS polarity_sign, speaker, participant_id, table_id, round_id, evidence_text, explicitness, confidence FROM s", "s")
def raw_stances(t):
    return R.raw_stances(t.s)


# ---- vocabulary and grounding

_MENTIONS = f",, m AS (SELECT source_label AS label, source_type AS type, 0 AS part, edge_id AS record, 0 AS side FROM e UNION ALL SELECT target_label, target_type, 0, edge_id, 1 FROM e UNION ALL SELECT concept_label, concept_type, 1, stance_id, 0 FROM s), n AS (SELECT *, {NORM.format('label')} AS norm, row_number() OVER (ORDER BY part, record, side) AS place FROM m)"
_COLLECTED = _MENTIONS + ", co AS (SELECT norm, trim(arg_min(label, place)) AS label, arg_min(type, place) AS type, count(*) AS mentions FROM n GROUP BY norm)"


@query(_MENTIONS + ", b AS (SELECT norm, type, count(*) AS c, min(place) AS f FROM n GROUP BY norm, type), o AS (SELECT norm, type, row_number() OVER (PARTITION BY norm ORDER BY c DESC, f) AS k FROM b) SELECT n.norm, trim(arg_min(n.label, place)) AS label, any_value(o.type) AS type, count(*) AS mentions FROM n JOIN o ON o.norm = n.norm AND k = 1 GROUP BY n.norm", "e s")
def candidates(t):
    return V.candidates(t.mentions)


@query(_COLLECTED + " SELECT * FROM co", "e s")
def mentions(t):
    return V.collected_mentions(t.mentions)


_ANGLE = "CAST({0} // 4 AS DOUBLE) * 0.3::DOUBLE + [0.0, 0.0, 0.05, 0.15][CAST({0} % 4 + 1 AS INT)]::DOUBLE"
_GROUNDED = (
    _COLLECTED
    + ", vo AS (SELECT node_id AS concept_id, label, CAST(split_part(node_id, ' ', 2) AS INT) AS ord FROM r WHERE CAST(split_part(node_id, ' ', 2) AS INT) % 4 = 0), ex AS (SELECT co.*, CAST(split_part(norm, ' ', 2) AS INT) AS k, a.concept_id AS by_label, b.concept_id AS by_alias FROM co LEFT JOIN vo a ON a.label = co.norm LEFT JOIN vo b ON 'concept ' || (b.ord + 1) = co.norm)"
    + f", si AS (SELECT norm, concept_id AS near, cos({_ANGLE.format('k')}) * cos({_ANGLE.format('ord')}) + sin({_ANGLE.format('k')}) * sin({_ANGLE.format('ord')}) AS sim, row_number() OVER (PARTITION BY norm ORDER BY sim DESC, ord) AS n FROM ex CROSS JOIN vo WHERE by_label IS NULL AND by_alias IS NULL)"
    + ", gr AS (SELECT norm, ex.label, ex.type, CASE WHEN by_label IS NOT NULL THEN 'exact_label' WHEN by_alias IS NOT NULL THEN 'alias' WHEN sim >= 0.99 THEN 'embedding' ELSE 'new_concept' END AS method, coalesce(by_label, by_alias, CASE WHEN sim >= 0.99 THEN near END, 'concept_' || substr(sha256(norm), 1, 12)) AS concept_id FROM ex LEFT JOIN si USING (norm) WHERE coalesce(n, 1) = 1)"
)


@query(_GROUNDED + " SELECT norm, CASE WHEN method IN ('exact_label', 'alias') THEN method END AS method, CASE WHEN method IN ('exact_label', 'alias') THEN concept_id END AS concept_id FROM gr", "e s r")
def ground_exact_alias(t):
    return V.exact_matches(V.collected_mentions(t.mentions), t.vocab).select("norm", "method", "concept_id")


@query(_GROUNDED + " SELECT norm, method, concept_id FROM gr", "e s r")
def grounding_report(t):
    return t.report.select("norm", "method", "concept_id")


@query(_GROUNDED + " SELECT method, count(*) AS mentions FROM gr GROUP BY method", "e s r")
def grounding_methods(t):
    return t.report.groupBy("method").agg(F.count(F.lit(1)).alias("mentions"))


@query(_GROUNDED + f" SELECT edge_id, a.concept_id AS source_node_id, b.concept_id AS target_node_id FROM e LEFT JOIN gr a ON a.norm = {NORM.format('source_label')} LEFT JOIN gr b ON b.norm = {NORM.format('target_label')}", "e s r")
def grounded_edges(t):
    return V.grounded_edges(t.e, t.report.select("norm", "concept_id")).select("edge_id", "source_node_id", "target_node_id")


@query(_GROUNDED + ", mo AS (SELECT concept_id, string_agg('|' || label, '' ORDER BY label) AS more FROM gr WHERE method = 'embedding' GROUP BY concept_id) SELECT concept_id, label, 'Concept  ' || (ord + 1) || coalesce(more, '') AS aliases, 7 AS mention_count FROM vo LEFT JOIN mo USING (concept_id) UNION ALL SELECT gr.concept_id, gr.norm, co.label, co.mentions FROM gr JOIN co USING (norm) WHERE method = 'new_concept'", "e s r")
def grown_vocabulary(t):
    return V.grown(t.vocab, t.report).select("concept_id", "label", F.array_join("aliases", "|").alias("aliases"), "mention_count")


_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f",, k AS (SELECT * FROM v WHERE vec_id < 30), x AS (SELECT a.vec_id AS key, b.vec_id AS concept, {_DOT} AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS n FROM v a JOIN k b ON a.type = b.type OR a.type NOT IN (SELECT type FROM k) WHERE a.vec_id >= 30) SELECT key, concept, similarity, similarity >= 0.15 AS grounded FROM x WHERE n = 1", "v")
def ground_nearest(t):
    vocab = t.v.where("vec_id < 30").select(F.col("vec_id").alias("concept"), "type", "embedding", F.col("vec_id").alias("ord"))
    return V.nearest(t.v.where("vec_id >= 30").withColumnRenamed("vec_id", "key"), vocab, 0.15)


def _entries(t) -> DataFrame:
    c = V.collected_mentions(t.mentions)
    return c.select(X.hashed_id(F.col("label")).alias("concept_id"), F.col("norm").alias("label"), "type", F.array("label").alias("aliases"), F.col("mentions").alias("mention_count"))


@query(_COLLECTED + ", tp AS (SELECT * FROM co ORDER BY mentions DESC, 'concept_' || substr(sha256(norm), 1, 12) LIMIT 20) SELECT type, '[' || type || '] ' || string_agg(norm, ', ' ORDER BY norm) AS line FROM tp GROUP BY type", "e s")
def vocab_block(t):
    return V.vocabulary_block(_entries(t), 20)


@query("SELECT node_id, label, type, 'Concept  ' || (CAST(split_part(node_id, ' ', 2) AS INT) + 1) AS aliases FROM r WHERE CAST(split_part(node_id, ' ', 2) AS INT) % 4 = 0", "r")
def registry(t):
    return V.registry_of(t.vocab).withColumn("aliases", F.array_join("aliases", "|"))


@query(f",, m AS (SELECT source_label AS label, source_type AS type, edge_id AS record, 0 AS side FROM e UNION ALL SELECT target_label, target_type, edge_id, 1 FROM e), n AS (SELECT *, {NORM.format('label')} AS norm, row_number() OVER (ORDER BY record, side) AS place FROM m), f AS (SELECT norm, label, min(place) AS first FROM n GROUP BY norm, label), a AS (SELECT norm, string_agg(label, '|' ORDER BY first) AS aliases FROM f GROUP BY norm) SELECT 'node_' || substr(sha256(n.norm), 1, 12) AS node_id, n.norm AS label, arg_min(type, place) AS type, any_value(aliases) AS aliases FROM n JOIN a ON a.norm = n.norm GROUP BY n.norm", "e")
def legacy_registry(t):
    return V.surface_registry(V.label_mentions(t.e)).withColumn("aliases", F.array_join("aliases", "|"))


@query()
def clusters(t):
    return V.clusters(t.v.withColumnRenamed("vec_id", "key"), 0.15, "key")


_FAMILY = _COLLECTED + ", fa AS (SELECT *, CAST(split_part(norm, ' ', 2) AS INT) % 5 AS cluster FROM co)"


def _families(t) -> DataFrame:
    return V.collected_mentions(t.mentions).withColumn("cluster", F.split_part("norm", F.lit(" "), F.lit(2)).cast("int") % 5)


@query(_FAMILY + " SELECT type, cluster, arg_min(label, struct_pack(a := -mentions, b := norm)) AS canonical_label FROM fa GROUP BY type, cluster", "e s")
def vocab_fallback_names(t):
    return V.named(_families(t)).drop("canonical_type")


@query(_FAMILY + " SELECT type, cluster, norm, rank FROM (SELECT *, row_number() OVER (PARTITION BY type, cluster ORDER BY mentions DESC, norm) AS rank FROM fa) WHERE rank <= 6", "e s")
def cluster_representatives(t):
    return V.representatives(_families(t)).select("type", "cluster", "norm", "rank")


@query(_FAMILY + f", nm AS (SELECT type, cluster, {NORM.format('arg_min(label, struct_pack(a := -mentions, b := norm))')} AS name FROM fa GROUP BY type, cluster) SELECT 'concept_' || substr(sha256(name), 1, 12) AS concept_id, name AS label, sum(mentions)::BIGINT AS mention_count, string_agg(DISTINCT label, '|' ORDER BY label) AS aliases FROM fa JOIN nm USING (type, cluster) GROUP BY name", "e s")
def vocabulary_assembly(t):
    f = _families(t)
    return V.vocabulary(f, V.named(f)).select("concept_id", "label", "mention_count", F.array_join("aliases", "|").alias("aliases"))


_CUE = "relation IN ('" + "', '".join(sorted(set(R.CUES) & set(D.RELATIONS))) + "')"


@query(f"SELECT edge_id AS turn_id, relation AS cue, relation, trim(source_label) AS \"left\", trim(target_label) AS \"right\" FROM e WHERE {_CUE} UNION ALL SELECT edge_id, 'due to', 'causes', CASE WHEN {_CUE} THEN trim(target_label) ELSE trim(concat_ws(' ', source_label, relation, target_label)) END, speaker FROM e", "e")
def causal_cues(t):
    return R.causal_cues(t.e.select(F.col("edge_id").alias("turn_id"), F.concat_ws(" ", "source_label", "relation", "target_label", F.lit("due to"), "speaker").alias("text")))


@query("SELECT edge_id, NOT (CAST(split_part(edge_id, '-', 2) AS INT) IN (1, 2, 3, 4)) AS valid, CASE WHEN CAST(split_part(edge_id, '-', 2) AS INT) IN (1, 2, 3, 4) THEN 0 ELSE 1 END AS strict_edges, CASE CAST(split_part(edge_id, '-', 2) AS INT) WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 0 ELSE 1 END AS loose_edges FROM e", "e")
def invalid_records(t):
    """Answers with an unknown relation, a confidence above 1, no evidence, or an invalid stance beside a valid edge."""
    n = F.split_part("edge_id", F.lit("-"), F.lit(2)).cast("int")
    edge = F.struct("source_label", "source_type", "target_label", "target_type", F.when(n == 1, "is like").otherwise(F.col("relation")).alias("relation"), F.when(n != 3, F.col("evidence_text")).alias("evidence_text"), "stance", "polarity", "explicitness", F.when(n == 2, 1.5).otherwise(F.col("confidence")).alias("confidence"))
    stance = F.struct(F.col("source_label").alias("concept_label"), F.when(n == 4, "no type").otherwise("topic").alias("concept_type"), "polarity", "evidence_text", "explicitness", "confidence")
    w = t.e.select("edge_id", F.to_json(F.struct(F.array(edge).alias("edges"), F.array(stance).alias("stances"))).alias("raw"))
    both = R.extracted(R.extracted(w).select("edge_id", "raw", "valid", F.size("edges").alias("strict_edges")), strict=False)
    return both.select("edge_id", "valid", "strict_edges", F.size("edges").alias("loose_edges"))


@query(f"SELECT DISTINCT {NORM.format('target_label')} AS norm FROM e", "e")
def speaker_labels_left_out(t):
    named = t.e.withColumn("source_label", F.concat(F.lit("Speaker_"), "participant_id"))
    return V.candidates(V.label_mentions(named)).select("norm")


# ---- evaluation and export


@query(" UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS mentions FROM e GROUP BY {c}" for c in ("relation", "stance", "explicitness", "polarity")), "e")
def metrics_distributions(t):
    return E.distributions(t.e)


@query(f"SELECT {MEAN_CONF} AS mean, median(confidence) AS median, min(confidence) AS min, max(confidence) AS max FROM e", "e")
def confidence_stats(t):
    return E.confidence_stats(t.e)


_IS = "relation IN ('{}')"
_CAUSAL, _VALUE = (_IS.format("', '".join(x)) for x in (D.CAUSAL_RELATIONS, D.VALUE_RELATIONS))


@query(f"SELECT count(*) FILTER ({_CAUSAL}) AS causal, count(*) FILTER ({_VALUE}) AS value_stance, count(*) FILTER (NOT {_CAUSAL} AND NOT {_VALUE}) AS other, avg(CASE WHEN {_CAUSAL} THEN 1 ELSE 0 END) AS causal_fraction, avg(CASE WHEN {_VALUE} THEN 1 ELSE 0 END) AS value_fraction FROM e", "e")
def causal_value_share(t):
    return E.causal_value_share(t.e)


@query("SELECT (SELECT CAST(count(source_node_id) + count(target_node_id) AS DOUBLE) / (2 * count(*)) FROM e) AS edge_endpoints_grounded_fraction, (SELECT CAST(count(concept_node_id) AS DOUBLE) / count(*) FROM s) AS stances_grounded_fraction, (SELECT count(DISTINCT id) FROM (SELECT source_node_id AS id FROM e UNION ALL SELECT target_node_id FROM e UNION ALL SELECT concept_node_id FROM s)) AS unique_grounded_concepts", "e s")
def grounding_coverage(t):
    return E.grounding_coverage(t.e, t.s)


@query(",, p AS (SELECT DISTINCT lower(source_label) AS s, relation AS r, lower(target_label) AS t FROM e WHERE round_id < '1997'), g AS (SELECT DISTINCT lower(source_label) AS s, relation AS r, lower(target_label) AS t FROM e WHERE round_id >= '1996'), n AS (SELECT (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM g)) AS tp, (SELECT count(*) FROM p) AS pc, (SELECT count(*) FROM g) AS gc) SELECT tp AS true_positives, pc AS predicted_count, gc AS gold_count, CAST(tp AS DOUBLE) / pc AS precision, CAST(tp AS DOUBLE) / gc AS recall, CASE WHEN tp > 0 THEN 2 * (CAST(tp AS DOUBLE) / pc) * (CAST(tp AS DOUBLE) / gc) / (CAST(tp AS DOUBLE) / pc + CAST(tp AS DOUBLE) / gc) ELSE 0 END AS f1 FROM n", "e")
def gold_prf(t):
    triple = t.e.select(F.col("source_label").alias("source"), "relation", F.col("target_label").alias("target"), "round_id")
    return E.precision_recall(triple.where("round_id < '1997'"), triple.where("round_id >= '1996'"))


_STAGE = {
    "concept_extraction": ["lower(source_label)", "lower(target_label)"],
    "concept_normalisation": ["lower(source_label) || '|' || coalesce(source_node_id, '')", "lower(target_label) || '|' || coalesce(target_node_id, '')"],
    "edge_detection": ["least(lower(source_label), lower(target_label)) || '|' || greatest(lower(source_label), lower(target_label))"],
    "relation_classification": ["concat_ws('|', lower(source_label), lower(target_label), relation)"],
    "causal_direction": ["CASE WHEN " + _CAUSAL + " THEN concat_ws('|', lower(source_label), lower(target_label)) END"],
    "stance_classification": ["concat_ws('|', lower(source_label), lower(target_label), relation, stance)"],
    "explicitness_classification": ["concat_ws('|', lower(source_label), lower(target_label), relation, explicitness)"],
}
_STAGES = " UNION ALL ".join(f"SELECT '{name}' AS stage, {key} AS key, round_id FROM e" for name, keys in _STAGE.items() for key in keys)


@query(f",, k AS ({_STAGES}), b AS (SELECT stage, key, bool_or(round_id < '1997') AS p, bool_or(round_id >= '1996') AS g FROM k WHERE key IS NOT NULL GROUP BY stage, key), n AS (SELECT stage, count(*) FILTER (p AND g) AS true_positives, count(*) FILTER (p) AS predicted_count, count(*) FILTER (g) AS gold_count FROM b GROUP BY stage) SELECT *, CAST(true_positives AS DOUBLE) / predicted_count AS precision, CAST(true_positives AS DOUBLE) / gold_count AS recall, 2 * (CAST(true_positives AS DOUBLE) / predicted_count) * (CAST(true_positives AS DOUBLE) / gold_count) / (CAST(true_positives AS DOUBLE) / predicted_count + CAST(true_positives AS DOUBLE) / gold_count) AS f1 FROM n", "e")
def stage_scores(t):
    return E.stage_scores(t.e.where("round_id < '1997'"), t.e.where("round_id >= '1996'"))


@query(_GROUPED + ", pp AS (SELECT DISTINCT participant_id FROM (SELECT participant_id FROM e UNION ALL SELECT participant_id FROM s)), gp AS (SELECT coalesce(political_affiliation, 'Unknown') AS grp, count(*) AS n FROM pp LEFT JOIN d USING (participant_id) GROUP BY 1) SELECT 'all' AS value, (SELECT count(*) FROM e) AS edge_count, (SELECT count(*) FROM pp) AS speaker_count UNION ALL SELECT ge.grp, count(*), any_value(gp.n) FROM ge JOIN gp ON gp.grp = ge.grp WHERE ge.grp <> 'Unknown' GROUP BY ge.grp", "e s d")
def affiliation_filters(t):
    return E.affiliation_filters(t.e, t.s, t.d)


@query("SELECT 'speaker' AS kind, participant_id AS value FROM (SELECT participant_id FROM e UNION SELECT participant_id FROM s) UNION ALL SELECT DISTINCT 'table', table_id FROM e UNION ALL SELECT DISTINCT 'round', round_id FROM e", "e s")
def metadata_values(t):
    return E.metadata(t.e, t.s)


@query("SELECT 'edges' AS kind, count(*) AS total FROM e UNION ALL SELECT 'stances', count(*) FROM s UNION ALL SELECT 'nodes', count(*) FROM r", "e s r")
def metadata_totals(t):
    return E.totals(t.e, t.s, t.r)


@query(",, o AS (SELECT source_node_id, target_node_id, relation, edge_id, CASE WHEN lag(relation) OVER w = relation THEN 0 ELSE 1 END AS new FROM e WHERE source_node_id IS NOT NULL AND target_node_id IS NOT NULL WINDOW w AS (PARTITION BY source_node_id, target_node_id ORDER BY edge_id)), u AS (SELECT *, sum(new) OVER (PARTITION BY source_node_id, target_node_id ORDER BY edge_id) AS run FROM o), l AS (SELECT *, max(run) OVER (PARTITION BY source_node_id, target_node_id) AS last FROM u) SELECT source_node_id, target_node_id, any_value(relation) AS relation, count(*) AS records, max(edge_id) AS last_record FROM l WHERE run = last GROUP BY source_node_id, target_node_id UNION ALL SELECT node_id, NULL, NULL, 0, NULL FROM r WHERE node_id NOT IN (SELECT source_node_id FROM l UNION SELECT target_node_id FROM l)", "e r")
def digraph_last_run(t):
    return G.digraph(t.e, t.r)


# ---- demographics files


def _cohorts(t) -> list[DataFrame]:
    d = t.d
    one = d.where("CAST(participant_id AS INT) % 2 = 0").select("participant_id", F.col("political_affiliation").alias("Political affiliation"), F.col("sex").alias("Sex"), "age")
    two = d.where("CAST(participant_id AS INT) % 3 = 0").select(F.col("participant_id").alias("Participant id"), F.lit("LATER").alias("U.s. political affiliation"), F.concat(F.lit(" "), "ethnicity").alias("Ethnicity simplified"), F.lit(" ").alias("Age"))
    return [one, two, d.select("sex")]


@query("SELECT participant_id, CASE WHEN p % 3 = 0 THEN 'LATER' ELSE political_affiliation END AS political_affiliation, CASE WHEN p % 2 = 0 THEN sex END AS sex, CASE WHEN p % 2 = 0 THEN age END AS age, CASE WHEN p % 3 = 0 THEN ethnicity END AS ethnicity FROM (SELECT *, CAST(participant_id AS INT) AS p FROM d) WHERE p % 2 = 0 OR p % 3 = 0", "d")
def demographics_merge(t):
    return files.demographics(files.merge_cohorts(_cohorts(t)))


@query(_SEGS2 + ", ends AS (SELECT source_node_id AS id FROM ea UNION ALL SELECT target_node_id FROM ea UNION ALL SELECT concept_node_id FROM sa UNION ALL SELECT source_node_id FROM eb UNION ALL SELECT target_node_id FROM eb UNION ALL SELECT concept_node_id FROM sb) SELECT r.node_id, count(ends.id) AS weight FROM r LEFT JOIN ends ON ends.id = r.node_id GROUP BY r.node_id", "e s d r")
def compare_weights(t):
    return viewer.compare_view(t.store, SEG_A, SEG_B)["nodes"].select("node_id", "weight")


@query(_GROUPED + f", q AS (SELECT {KEYS}, bool_or(grp = 'AUTOMOBILE') AS in_a, bool_or(grp = 'BUILDING') AS in_b FROM ge WHERE grp IN ('AUTOMOBILE', 'BUILDING') AND source_node_id IS NOT NULL AND target_node_id IS NOT NULL GROUP BY {KEYS}) SELECT 'AUTOMOBILE' AS group_a, 'BUILDING' AS group_b, count(*) FILTER (in_a AND in_b) AS shared_triples, count(*) FILTER (in_a AND NOT in_b) AS only_a_triples, count(*) FILTER (in_b AND NOT in_a) AS only_b_triples, CAST(count(*) FILTER (in_a AND in_b) AS DOUBLE) / count(*) AS triple_jaccard FROM q", "e s d")
def group_overlap_headline(t):
    return run.metrics(t.e, t.s, t.d)["group_overlap"]


@query(_FAMILY + " SELECT type, cluster, CASE WHEN cluster % 2 = 0 THEN type || '/' || cluster ELSE arg_min(label, struct_pack(a := -mentions, b := norm)) END AS canonical_label FROM fa GROUP BY type, cluster", "e s")
def assigned_cluster_names(t):
    """A namer that names every second cluster by its first phrase's family; the others keep their own name."""
    members = _families(t)

    def namer(batch):
        family = lambda phrase: int(phrase.split()[1]) % 5
        return [(n, f"{kind}/{family(phrases[0])}", kind) for n, kind, phrases in batch if family(phrases[0]) % 2 == 0] + [(-1, "x", "topic"), (0, "x", "no type")][:1]

    return V.named(members, assigned_names(members, namer, 4)).select("type", "cluster", "canonical_label")


# ---- wider measures


@query(" UNION ALL ".join(f"SELECT {r} AS relation, {a} AS table_id, {o} AS round_id, count(*) AS mentions, count(DISTINCT participant_id) AS speakers FROM e {g}" for r, a, o, g in (("NULL", "NULL", "NULL", ""), ("relation", "NULL", "NULL", "GROUP BY relation"), ("NULL", "table_id", "NULL", "GROUP BY table_id"), ("NULL", "NULL", "round_id", "GROUP BY round_id"))), "e")
def grouping_sets_edges(t):
    return G.grouping_sets(t.e)


@query(f"SELECT table_id, round_id, count(*) AS mentions, count(DISTINCT participant_id) AS speakers, {MEAN_SIGN} AS mean_polarity, " + ", ".join(f"CAST(count(*) FILTER (stance = '{s}') AS DOUBLE) / count(*) AS share_{s}" for s in ("asserted", "rejected", "questioned")) + ", CAST(count(*) FILTER (explicitness = 'explicit') AS DOUBLE) / count(*) AS share_explicit, CAST(count(*) FILTER (explicitness = 'inferred') AS DOUBLE) / count(*) AS share_inferred, min(round_id) AS first_round, max(round_id) AS last_round FROM e GROUP BY table_id, round_id", "e")
def grouped_measures(t):
    return G.grouped_edges(t.e, "table_id", "round_id")


@query(f"SELECT {KEYS}, count(*) FILTER (stance = 'asserted') AS asserted, count(*) FILTER (stance = 'rejected') AS rejected, bool_or(stance = 'asserted') AND bool_or(stance = 'rejected') AS disputed FROM e GROUP BY {KEYS}", "e")
def disagreement_badge(t):
    return G.disagreement(t.e)


@query(f"SELECT {KEYS}, count(*) AS mentions, count(DISTINCT participant_id) AS speakers FROM e GROUP BY {KEYS} HAVING count(DISTINCT participant_id) >= 5", "e")
def small_cell_suppressed(t):
    return G.suppress_small(t.e)


@query(f"SELECT *, mentions - lag(mentions) OVER (PARTITION BY {KEYS} ORDER BY round_id) AS change FROM (SELECT {KEYS}, round_id, count(*) AS mentions FROM e GROUP BY {KEYS}, round_id)", "e")
def round_evolution(t):
    return G.round_evolution(t.e)


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({_DOT}, 9) AS similarity FROM v a JOIN v b ON a.type = b.type AND a.vec_id < b.vec_id WHERE {_DOT} >= 0.3 AND NOT (a.vec_id % 7 = 0 AND b.vec_id % 3 = 0)", "v")
def merge_proposals(t):
    """With a reviewer's decisions on some of them: rejected ones go, approved ones stay."""
    v = t.v.withColumnRenamed("vec_id", "key")
    reviewed = V.merge_proposals(v, 0.3).where("b % 3 = 0").select("a", "b", F.expr("CASE WHEN a % 7 = 0 THEN 'reject' ELSE 'approve' END").alias("action"))
    return V.merge_proposals(v, 0.3, reviewed).withColumn("similarity", F.round("similarity", 9))


_REVIEWS = "SELECT edge_id, k AS review_id, k % 3 AS reviewed_at, CASE (ln + k) % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'edit' ELSE 'flip' END AS action, 'reports' AS new_relation FROM (SELECT edge_id, CAST(split_part(edge_id, '-', 2) AS INT) AS ln, CAST(split_part(edge_id, '-', 3) AS INT) AS pk FROM e) CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) q WHERE pk % 5 = 0"


@query(f",, rv AS ({_REVIEWS}), la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY reviewed_at DESC, review_id DESC) AS n FROM rv) WHERE n = 1) SELECT e.edge_id, CASE WHEN action = 'flip' THEN target_node_id ELSE source_node_id END AS source_node_id, CASE WHEN action = 'flip' THEN source_node_id ELSE target_node_id END AS target_node_id, CASE WHEN action = 'edit' THEN new_relation ELSE relation END AS relation, coalesce(action, 'unreviewed') AS review FROM e LEFT JOIN la USING (edge_id) WHERE coalesce(action <> 'reject', true)", "e")
def review_overrides(t):
    e = t.e
    made = e.select("edge_id", F.split_part("edge_id", F.lit("-"), F.lit(2)).cast("int").alias("ln"), F.split_part("edge_id", F.lit("-"), F.lit(3)).cast("int").alias("pk")).where("pk % 5 = 0").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).drop("pk")
    made = made.selectExpr("edge_id", "k AS review_id", "k % 3 AS reviewed_at", "CASE (ln + k) % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'edit' ELSE 'flip' END AS action", "'reports' AS new_relation")
    return R.reviewed(e, made).select("edge_id", "source_node_id", "target_node_id", "relation", "review")


@query("SELECT edge_id FROM e WHERE participant_id NOT IN (SELECT participant_id FROM d WHERE sex = 'CONSENT_REVOKED')", "e d")
def speaker_deletion(t):
    return R.without_participants(t.e, t.d.where("sex = 'CONSENT_REVOKED'")).select("edge_id")
