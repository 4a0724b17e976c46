"""One query per operator over the driver's tables, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartcast.llm.common import read_table, ship_package
from cartcast.llm.embedding_dedup import near_duplicates
from cartcast.llm.exact_dedup import exact_duplicates
from cartcast.llm.filter_audit import filter_audit
from cartcast.llm.licenses import license_scan
from cartcast.llm.merkle import audited_manifest
from cartcast.llm.mixing import DOMAINS, domain_labels, mixed
from cartcast.llm.ngram_join import jaccard_links
from cartcast.llm.packing import best_fit_packing
from cartcast.llm.quality import quality_scores
from cartcast.llm.quality_rules import quality_rules
from cartcast.llm.substring_dedup import repeated_spans
from cartcast.llm.toxicity import toxicity_scores
from cartcast.llm.url_filter import url_verdicts

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(read_table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(read_table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = url_verdicts(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "labels"))
    return rows.withColumns({c: F.round(c, 6) for c in ("good_rate", "good_rate_bound")})


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    return mixed(read_table(spark, sf_dir, "documents"), domain_labels(labels), DOMAINS)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited_manifest(read_table(spark, sf_dir, "documents"))


def _shipped(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    f.__name__: _shipped(f)
    for f in (
        op1_substring_dedup,
        op2_ngram_join,
        op3_embedding_dedup,
        op4_toxicity,
        op5_url_filter,
        op6_mixing,
        op7_quality,
        op8_packing,
        op9_exact_dedup,
        op10_license_scan,
        op11_quality_rules,
        op12_filter_audit,
        op13_merkle_manifest,
    )
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_FOLDED = f"translate(coalesce(text, ''), {_AZ})"

# Pairs (a, b) of linked ids in both directions, closed over by the smallest id reachable.
_REACHABLE = """reach(id, other) AS (
  SELECT a, b FROM link UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.other = l.a
),
lowest AS (SELECT id, min(other) AS low FROM reach GROUP BY id),
degree AS (SELECT a AS id, count(*) AS n FROM link GROUP BY a)"""

# What is 1 / rho - 1 for counts (n, good) of units around the rate p of their parents.
_STRENGTH = """SELECT CASE WHEN coalesce(room, 0) = 0 THEN 1.0
  ELSE 1 / least(greatest((seen - noise) / room, 1 / 1001.0), 0.5) - 1 END AS s
FROM (SELECT sum(n * (good / n - p) * (good / n - p)) AS seen, sum(p * (1 - p)) AS noise, sum(p * (1 - p) * (n - 1)) AS room
      FROM {level} WHERE n > 0)"""

def _levels(name: str, base: str) -> str:
    """CTE ``name(tree, k, i, h, m)``: every node of the trees whose leaves ``base`` gives."""
    return f"""{name}(tree, k, i, h, m) AS (
          {base}
          UNION ALL
          SELECT tree, k + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(m) + 1) // 2
          FROM {name} WHERE m > 1 GROUP BY tree, k, i // 2
        )"""


def _leaf(n_chars: str) -> str:
    """Leaf digest of a document, with this expression for its n_chars."""
    values = [n_chars if c == "n_chars" else c for c in ("doc_id", "source", "lang", "n_chars", "text")]
    texts = [f"CAST({v} AS VARCHAR)" for v in values]
    return "sha256(" + " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in texts) + ")"


# CRC-32 by its definition, a bit at a time: the remainder of the id's digits.
_CRC = """crc(id, bits, c) AS (
          SELECT DISTINCT CAST(doc_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM documents WHERE doc_id IS NOT NULL
          UNION ALL
          SELECT id, bits + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, CAST(3988292384 AS BIGINT)) ELSE x >> 1 END
          FROM (SELECT id, bits, CASE WHEN bits % 8 = 0 THEN xor(c, CAST(ascii(id[bits // 8 + 1]) AS BIGINT)) ELSE c END AS x
                FROM crc WHERE bits < 8 * length(id))
        )"""

ORACLE_SQL: dict[str, str] = {
    "op12_filter_audit": """
        WITH d AS (
          SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                 regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
          FROM documents
        ),
        least AS (SELECT t, min(doc_id) AS m FROM d GROUP BY t),
        l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        f AS (
          SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                 CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                 + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
                 + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN m < doc_id THEN 16 ELSE 0 END AS mask
          FROM d JOIN least USING (t) LEFT JOIN l USING (doc_id)
        ),
        c AS (
          SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL
        ),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (
          SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e
          WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ),
        s AS (
          SELECT o, step, 1 << (ascii(o[step]) - 65) AS bit, list_sum([1 << (ascii(z) - 65) FOR z IN string_split(o[1:step - 1], '') IF z != '']) AS b
          FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
        ),
        r AS (
          SELECT part, o, step, bit,
                 coalesce(sum(n) FILTER (mask & (bit | coalesce(b, 0)) = 0), 0) AS kept,
                 coalesce(sum(n) FILTER (mask & bit != 0 AND mask & coalesce(b, 0) = 0), 0) AS removed,
                 coalesce(sum(n) FILTER (mask & bit != 0 AND mask & coalesce(b, 0) != 0), 0) AS redundant,
                 coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
                 coalesce(sum(good) FILTER (mask & bit != 0 AND mask & coalesce(b, 0) = 0), 0) AS good_lost,
                 coalesce(sum(toxic) FILTER (mask & bit != 0 AND mask & coalesce(b, 0) = 0), 0) AS toxic_lost
          FROM c, s GROUP BY part, o, step, bit
        )
        SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
               CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
               CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
        FROM r""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE {_CRC},
        leaf AS (
          SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS h,
                 CASE WHEN c.id IS NOT NULL THEN {_leaf("CAST(n_chars AS HUGEINT) + 1")} ELSE {_leaf("n_chars")} END AS tried
          FROM documents LEFT JOIN crc c ON c.id = CAST(doc_id AS VARCHAR) AND c.bits = 8 * length(c.id)
               AND xor(c.c, CAST(4294967295 AS BIGINT)) % 7 = 0
        ),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS m
          FROM leaf
        ),
        {_levels("node", "SELECT tree, 0, i, h, m FROM ranked")},
        place AS (
          SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS m FROM node WHERE m = 1
        ),
        {_levels("forest", "SELECT '', 0, i, h, m FROM place")},
        step AS (
          SELECT r.tree, r.i, n.k, (r.i >> n.k) % 2 AS side, s.h
          FROM ranked r JOIN node n ON n.tree = r.tree AND n.i = r.i >> n.k AND n.m > 1
          LEFT JOIN node s ON s.tree = n.tree AND s.k = n.k AND s.i = CASE WHEN n.i % 2 = 1 THEN n.i - 1 ELSE n.i + 1 END
          UNION ALL
          SELECT r.tree, r.i, 1000 + f.k, (p.i >> f.k) % 2, s.h
          FROM ranked r JOIN place p USING (tree) JOIN forest f ON f.i = p.i >> f.k AND f.m > 1
          LEFT JOIN forest s ON s.k = f.k AND s.i = CASE WHEN f.i % 2 = 1 THEN f.i - 1 ELSE f.i + 1 END
        ),
        path AS (
          SELECT tree, i, string_agg(h, '' ORDER BY k) AS proof,
                 list(CASE WHEN h IS NULL THEN '2' ELSE CAST(side AS VARCHAR) || h END ORDER BY k) AS steps
          FROM step GROUP BY tree, i
        ),
        fold(tree, i, h, steps) AS (
          SELECT r.tree, r.i, r.tried, coalesce(p.steps, []) FROM ranked r LEFT JOIN path p ON p.tree = r.tree AND p.i = r.i
          UNION ALL
          SELECT tree, i, sha256(CASE steps[1][1] WHEN '2' THEN h WHEN '1' THEN steps[1][2:] || h ELSE h || steps[1][2:] END), steps[2:]
          FROM fold WHERE len(steps) > 0
        ),
        top AS (SELECT h FROM forest WHERE m = 1)
        SELECT r.doc_id, r.h AS leaf, p.h AS subroot, t.h AS root, sha256(coalesce(x.proof, '')) AS proof_sha256,
               f.h AS folded_root, f.h = t.h AS verified
        FROM ranked r JOIN place p USING (tree) JOIN fold f ON f.tree = r.tree AND f.i = r.i AND len(f.steps) = 0
        LEFT JOIN path x ON x.tree = r.tree AND x.i = r.i CROSS JOIN top t""",
    "op2_ngram_join": f"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        s AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
            ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) END AS s
          FROM w
        ),
        e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        pair AS (
          SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS i
          FROM e x JOIN e y ON x.g = y.g AND x.doc_id != y.doc_id GROUP BY x.doc_id, y.doc_id
        ),
        link AS (SELECT a, b FROM pair WHERE 100 * i >= 90 * (na + nb - i)),
        {_REACHABLE}
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.low, s.doc_id)) AS component_id,
               CAST(coalesce(d.n, 0) AS BIGINT) AS n_links
        FROM s LEFT JOIN lowest l ON l.id = s.doc_id LEFT JOIN degree d ON d.id = s.doc_id""",
    "op3_embedding_dedup": f"""
        WITH RECURSIVE v AS (
          SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
          WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x != 0)) > 0
        ),
        link AS (
          SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id != y.vec_id AND len(x.v) = len(y.v)
          WHERE list_cosine_similarity(x.v, y.v) >= 0.95
        ),
        {_REACHABLE}
        SELECT e.vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(l.low, e.vec_id)) AS component_id,
               e.vec_id <= coalesce(l.low, e.vec_id) AS kept
        FROM embeddings e LEFT JOIN lowest l ON l.id = e.vec_id LEFT JOIN degree d ON d.id = e.vec_id""",
    "op5_url_filter": f"""
        WITH h AS (
          SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), {_AZ}) AS host,
                 regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
          FROM pages
        ),
        c AS (
          SELECT host, regexp_extract(host, '([^.]*[.])?[^.]*$') AS domain, regexp_extract(host, '[^.]*$') AS suffix,
                 count(*) AS n, CAST(sum(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS good
          FROM h JOIN labels l ON l.doc_id = TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:[.][A-Za-z]+)?/?$', 1) AS BIGINT)
          WHERE host != '' AND quality IS NOT NULL GROUP BY ALL
        ),
        t AS (SELECT coalesce(sum(n), 0) AS n, (coalesce(sum(good), 0) + 0.5) / (coalesce(sum(n), 0) + 1.0) AS p FROM c),
        sl AS (SELECT suffix, sum(c.n) AS n, sum(good) AS good, any_value(t.p) AS p FROM c, t GROUP BY suffix),
        ss AS ({_STRENGTH.format(level="sl")}),
        sf AS (SELECT suffix, (good + s * p) / (n + s) AS m, n + s AS w FROM sl, ss),
        dl AS (SELECT domain, sum(c.n) AS n, sum(good) AS good, any_value(sf.m) AS p FROM c JOIN sf USING (suffix) GROUP BY domain),
        ds AS ({_STRENGTH.format(level="dl")}),
        dm AS (SELECT domain, (good + s * p) / (n + s) AS m, n + s AS w FROM dl, ds),
        hl AS (
          SELECT k.host, coalesce(c.n, 0) AS n, coalesce(c.good, 0) AS good, coalesce(dm.m, sf.m, t.p) AS p,
                 coalesce(dm.w, sf.w, t.n + 1) AS above
          FROM (SELECT DISTINCT host FROM h) k CROSS JOIN t LEFT JOIN c ON c.host = k.host
          LEFT JOIN dm ON dm.domain = regexp_extract(k.host, '([^.]*[.])?[^.]*$')
          LEFT JOIN sf ON sf.suffix = regexp_extract(k.host, '[^.]*$')
        ),
        hs AS ({_STRENGTH.format(level="hl")}),
        hm AS (
          SELECT host, m, greatest(m - 1.645 * sqrt(m * (1 - m) / (w + 1)), 0) AS lower
          FROM (SELECT host, (good + s * p) / (n + s) AS m, CASE WHEN n > 0 THEN n + s ELSE above END AS w FROM hl, hs)
        ),
        r AS (
          SELECT h.*, hm.m, hm.lower,
            CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
          FROM h JOIN hm USING (host)
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
                    WHEN lower >= 0.5 THEN 'allow' ELSE 'block' END AS verdict,
               round(m, 6) AS good_rate, round(lower, 6) AS good_rate_bound
        FROM r""",
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_FOLDED}) AS h FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY h) AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY h) AS kept,
               h AS text_sha256
        FROM d""",
}
