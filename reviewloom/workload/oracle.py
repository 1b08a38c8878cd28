"""SQL giving the rows of the queries, written for DuckDB on the same tables."""

from __future__ import annotations

from reviewloom.functions.text import CLOSED_CLASSES, DOUBLED, ENDINGS, HAD_E, PUNCTUATION, VOWEL
from reviewloom.operators.lemmas import DOMAIN_STOP_WORDS, KEEP_POS
from reviewloom.workload.queries import BLOCKED, CHECKED, MIN_DF, PAGE_SIZE

W = r"\p{L}\p{N}_"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "(" + ", ".join(_q(w) for w in words) + ")"


# --- views -----------------------------------------------------------------

EMPLOYERS = """emp AS (
  SELECT p_partkey AS company_id, p_name AS company_name, p_brand AS industry,
         count(*) AS num_ratings, avg(l_quantity) / 10 AS overall_rating
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_partkey, p_name, p_brand)"""

SELECTED = (
    EMPLOYERS
    + """, big AS (SELECT * FROM emp WHERE num_ratings >= 30),
cut AS (SELECT round(quantile_cont(overall_rating, 0.05), 1) AS low,
               round(quantile_cont(overall_rating, 0.95), 1) AS high FROM big),
tails AS (SELECT big.* FROM big, cut WHERE overall_rating <= low OR overall_rating >= high)"""
)

REVIEWS = """fx AS (
  SELECT d.doc_id, d.source AS company_name,
         CASE WHEN l.quality = 1 THEN 'pro' WHEN l.quality = 0 THEN 'con' END AS pro_or_con,
         d.text AS review_text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

TARGETS = """targets AS (
  SELECT CAST(substr(source, 4) AS BIGINT) AS company_id, source AS company_name,
         CASE WHEN source IN ('src0', 'src1', 'src2') THEN 3 * count(*)
              WHEN source = 'src3' THEN 2 * count(*) ELSE count(*) END AS num_ratings,
         CASE WHEN source = 'src0' THEN 4.4e0 WHEN source = 'src1' THEN 2.4e0 ELSE 3.5e0 END AS overall_rating
  FROM documents GROUP BY source
  UNION ALL SELECT 999, 'absent', 100, 4.8e0)"""


def _coverage(key: str, extra: str = "") -> str:
    return f"""WITH {REVIEWS}, {TARGETS},
counts AS (SELECT {key}, count(*) AS ratings_collected FROM (SELECT *{extra} FROM fx)
           WHERE {key} IS NOT NULL GROUP BY {key}),
checked AS (SELECT t.*, c.ratings_collected, t.num_ratings - c.ratings_collected AS delta,
                   (t.num_ratings - c.ratings_collected) / t.num_ratings AS delta_pct
            FROM targets t LEFT JOIN counts c USING ({key}))"""


CHECK_COLUMNS = (
    "company_id, company_name, num_ratings, overall_rating, ratings_collected, delta, round(delta_pct, 6) AS delta_pct"
)

# --- text ------------------------------------------------------------------

TERMS = rf"regexp_extract_all(lower(coalesce(review_text, '')), '[{W}]{{2,}}')"


def _tokens(column: str) -> str:
    marked = rf"""regexp_replace(lower(coalesce({column}, '')), 'n[''’]t([^{W}]|$)', ' n' || chr(1) || 't\1', 'g')"""
    marked = rf"""regexp_replace({marked}, '[''’](s|m|re|ve|ll|d)([^{W}]|$)', ' ' || chr(1) || '\1\2', 'g')"""
    found = rf"regexp_extract_all({marked}, 'n?' || chr(1) || '[a-z]+|[{W}]+')"
    return f"list_transform({found}, lambda t: replace(t, chr(1), ''''))"


def _stem(word: str) -> str:
    def ends(ending: str, shortest: int) -> str:
        return f"(ends_with({word}, '{ending}') AND length({word}) >= {shortest})"

    def cut(n: int) -> str:
        return f"substr({word}, 1, length({word}) - {n})"

    def base(n: int) -> str:
        return f"""CASE WHEN regexp_matches({cut(n)}, '{DOUBLED}') THEN {cut(n + 1)}
    WHEN regexp_matches({cut(n)}, '{HAD_E}') THEN {cut(n)} || 'e' ELSE {cut(n)} END"""

    def voiced(n: int) -> str:
        return f"regexp_matches({cut(n)}, '{VOWEL}')"

    return f"""CASE WHEN ends_with({word}, 'ss') OR ends_with({word}, 'us') OR ends_with({word}, 'is')
    OR ends_with({word}, 'eed') THEN {word}
  WHEN {ends("sses", 6)} THEN {cut(2)}
  WHEN {ends("ies", 5)} THEN {cut(3)} || 'y'
  WHEN {ends("ches", 6)} OR {ends("shes", 6)} OR {ends("xes", 5)} OR {ends("zes", 5)} THEN {cut(2)}
  WHEN {ends("s", 4)} THEN {cut(1)} WHEN {ends("ing", 6)} AND {voiced(3)} THEN {base(3)}
  WHEN {ends("ed", 4)} AND {voiced(2)} THEN {base(2)}
  ELSE {word} END"""


def _pos(word: str) -> str:
    parts = [f"WHEN {word} IN {_list(words)} THEN '{tag}'" for tag, words in CLOSED_CLASSES.items()]
    parts.append(f"WHEN {word} = 'n''t' THEN 'ADV'")
    parts.append(rf"WHEN regexp_matches({word}, '^\p{{N}}+$') THEN 'NUM'")
    parts += [f"WHEN ends_with({word}, '{e}') THEN '{tag}'" for tag, ends in ENDINGS.items() for e in ends]
    return "CASE " + " ".join(parts) + " ELSE 'NOUN' END"


LEXICON = f"""lexicon AS (
  SELECT token, CASE WHEN token IN ('on', 'that') THEN 'bos' ELSE substr(token, 1, 5) END AS lemma,
         CASE length(token) % 4 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' WHEN 2 THEN 'DET' ELSE 'ADJ' END AS pos
  FROM (SELECT DISTINCT unnest({_tokens("text")}) AS token FROM benchmark))"""


def _lemmas(with_lexicon: bool) -> str:
    stem = f"CASE WHEN token IN {_list(DOMAIN_STOP_WORDS)} THEN token ELSE {_stem('token')} END"
    pos = _pos("token")
    strip = f"trim(lemma, {_q(PUNCTUATION)})"
    if with_lexicon:
        tagged = f"""SELECT doc_id, position, coalesce(lemma, {stem}) AS lemma, coalesce(pos, {pos}) AS pos
                     FROM tok LEFT JOIN lexicon USING (token)"""
    else:
        tagged = f"SELECT doc_id, position, {stem} AS lemma, {pos} AS pos FROM tok"
    head = f"{REVIEWS}, {LEXICON}" if with_lexicon else REVIEWS
    return f"""WITH {head},
lists AS MATERIALIZED (SELECT doc_id, {_tokens("review_text")} AS toks FROM fx),
tok AS (SELECT doc_id, unnest(toks) AS token, unnest(range(len(toks))) AS position FROM lists),
tagged AS MATERIALIZED ({tagged}),
lem AS (SELECT doc_id, 0 AS late, position, {strip} AS lemma FROM tagged
        WHERE pos IN {_list(KEEP_POS)} AND {strip} NOT IN {_list(DOMAIN_STOP_WORDS)}
        UNION ALL SELECT doc_id, 1, position, 'boss' FROM tagged WHERE lemma = 'bos'),
texts AS (SELECT doc_id, string_agg(lemma, ' ' ORDER BY late, position) AS lemmatized_text FROM lem GROUP BY doc_id)"""


def _entities(markup: str) -> str:
    plain = f"regexp_replace({markup}, '<[^>]*>', '', 'g')"
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        plain = f"replace({plain}, '&{name};', '{char}')"
    return plain


TITLE = _entities("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")
SLUG = f"replace(replace(replace(replace(strip_accents({TITLE}), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), ' ', '-')"
PARAGRAPHS = "regexp_split_to_array(block, '(?i)<p(?:\\s[^>]*)?>')"

# --- weights ---------------------------------------------------------------


def _weights(
    polarity: str | None = None,
    tag: str = "",
    idf: str = "ln((1.0e0 + n) / (1 + df)) + 1",
    normalize: bool = True,
    min_df: int = MIN_DF,
    max_df: str = "0.9e0",
    max_features: int | None = None,
    words: str = "w",
) -> str:
    where = "" if polarity is None else f" WHERE pro_or_con = '{polarity}'"
    limit = "" if max_features is None else f" ORDER BY total DESC, term LIMIT {max_features}"
    length = "sqrt(sum(w * w) OVER (PARTITION BY doc_id))" if normalize else "1"
    return f"""docs{tag} AS (SELECT doc_id, review_text FROM fx{where}),
n{tag} AS (SELECT count(*) AS n FROM docs{tag}),
tf{tag} AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf
       FROM (SELECT doc_id, unnest({words}) AS term FROM (SELECT doc_id, {TERMS} AS w FROM docs{tag})) GROUP BY ALL),
kept{tag} AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf{tag} GROUP BY term
       HAVING count(*) >= {min_df} AND count(*) <= {max_df} * (SELECT n FROM n{tag}){limit}),
voc{tag} AS MATERIALIZED (SELECT term, df, total, row_number() OVER (ORDER BY term) - 1 AS term_idx, {idf} AS idf
       FROM kept{tag}, n{tag}),
mat{tag} AS MATERIALIZED (SELECT doc_id, term, term_idx, tf, w / {length} AS x
       FROM (SELECT doc_id, term, term_idx, tf, tf * idf AS w FROM tf{tag} JOIN voc{tag} USING (term)))"""


def _weight_query(**options) -> str:
    return f"WITH {REVIEWS}, {_weights(**options)} SELECT doc_id, term, term_idx, tf, round(x, 6) AS tfidf FROM mat"


BIGRAMS = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"

# --- factorisation ---------------------------------------------------------

K = range(CHECKED.topics)


def _start(tag: str) -> str:
    """The first H: means of the documents with the smallest digests, dealt out in turn."""
    many = len(K) * CHECKED.seed_documents
    means = ", ".join(
        f"coalesce(sum(CASE WHEN topic = {t} THEN x END), 0) / {CHECKED.seed_documents}e0 AS h{t}" for t in K
    )
    return f"""dealt{tag} AS (SELECT doc_id, (place - 1) % {len(K)} AS topic FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|{CHECKED.seed}'), doc_id) AS place
  FROM (SELECT DISTINCT doc_id FROM mat{tag})) WHERE place <= {many}),
h{tag}_0 AS MATERIALIZED (SELECT term_idx, {means}
  FROM voc{tag} LEFT JOIN (SELECT term_idx, x, topic FROM mat{tag} JOIN dealt{tag} USING (doc_id)) USING (term_idx)
  GROUP BY term_idx)"""


def _gram(name: str, source: str, v: str) -> str:
    sums = ", ".join(f"sum({v}{i} * {v}{j}) AS g{i}{j}" for i in K for j in K)
    return f"{name} AS MATERIALIZED (SELECT {sums} FROM {source})"


def _solve(name: str, source: str, gram: str, key: str, goal: str, v: str) -> list[str]:
    """Coordinate descent written out: one step of one topic per table."""
    zeros = ", ".join(f"0e0 AS {v}{i}" for i in K)
    goals = ", ".join(f"{goal}{i}" for i in K)
    steps = [f"{name}_0 AS (SELECT {key}, {goals}, {zeros} FROM {source})"]
    last = f"{name}_0"
    for sweep in range(CHECKED.sweeps):
        for j in K:
            rest = " - ".join(f"g{i}{j} * {v}{i}" for i in K if i != j)
            new = f"greatest(0e0, ({goal}{j} - {CHECKED.l1!r}e0 - {rest}) / (g{j}{j} + {CHECKED.l2!r}e0)) AS {v}{j}"
            others = ", ".join(f"{v}{i}" for i in K if i != j)
            step = f"{name}_{sweep + 1}_{j}"
            steps.append(f"{step} AS (SELECT {key}, {goals}, {others}, {new} FROM {last}, {gram})")
            last = step
    steps.append(f"{name} AS MATERIALIZED (SELECT * FROM {last})")
    return steps


def _factors(tag: str = "") -> str:
    """Tables w<r> and h<r> after each round; the last document step has its own number."""
    parts = [_start(tag)]
    rounds = CHECKED.max_rounds
    for r in range(1, rounds + 2):
        h, w = f"h{tag}_{r - 1}", f"w{tag}_{r}"
        sums = ", ".join(f"sum(x * h{i}) AS a{i}" for i in K)
        parts.append(_gram(f"hg{tag}_{r}", h, "h"))
        parts.append(f"a{tag}_{r} AS (SELECT doc_id, {sums} FROM mat{tag} JOIN {h} USING (term_idx) GROUP BY doc_id)")
        parts += _solve(w, f"a{tag}_{r}", f"hg{tag}_{r}", "doc_id", "a", "w")
        if r > rounds:
            break
        sums = ", ".join(f"sum(x * w{i}) AS b{i}" for i in K)
        parts.append(_gram(f"wg{tag}_{r}", w, "w"))
        parts.append(f"b{tag}_{r} AS (SELECT term_idx, {sums} FROM mat{tag} JOIN {w} USING (doc_id) GROUP BY term_idx)")
        parts += _solve(f"h{tag}_{r}", f"b{tag}_{r}", f"wg{tag}_{r}", "term_idx", "b", "h")
    final_h = f"SELECT term, h.* FROM h{tag}_{rounds} h JOIN voc{tag} USING (term_idx)"
    parts.append(f"w{tag} AS (SELECT * FROM w{tag}_{rounds + 1}), h{tag} AS MATERIALIZED ({final_h})")
    return ",\n".join(parts)


FIT = f"WITH {REVIEWS}, {_weights('pro')},\n{_factors()}"

_TOTAL_W = " + ".join(f"w{i}" for i in K)
_SHARES = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS topic, CASE WHEN {_TOTAL_W} > 0 THEN w{i} / ({_TOTAL_W}) END AS pct FROM w" for i in K
)
_TERM_ROWS = " UNION ALL ".join(f"SELECT {i} AS topic, term, h{i} AS weight FROM h" for i in K)
REPORT = f"""{FIT},
shares AS ({_SHARES}), labels_ AS (SELECT * FROM shares WHERE pct >= 0.20e0),
terms_ AS ({_TERM_ROWS}),
freq AS (SELECT topic, term, weight / nullif(sum(weight) OVER (PARTITION BY topic), 0) AS frequency FROM terms_),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term) AS rank FROM terms_),
cloud AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY frequency DESC NULLS LAST, term) AS rank FROM freq),
sizes AS (SELECT t.topic, count(l.doc_id) AS n_docs
          FROM (SELECT unnest(range({len(K)})) AS topic) t LEFT JOIN labels_ l ON t.topic = l.topic GROUP BY t.topic),
dots AS (SELECT a.topic AS topic_a, b.topic AS topic_b, sum(a.weight * b.weight) AS dot
         FROM terms_ a JOIN terms_ b USING (term) GROUP BY ALL),
cosines AS (SELECT d.topic_a, d.topic_b, coalesce(d.dot / nullif(sqrt(x.dot) * sqrt(y.dot), 0), 0) AS cosine
            FROM dots d JOIN dots x ON x.topic_a = d.topic_a AND x.topic_b = d.topic_a
            JOIN dots y ON y.topic_a = d.topic_b AND y.topic_b = d.topic_b WHERE d.topic_a < d.topic_b)"""


def _vector(v: str) -> str:
    return ", ".join(f"round({v}{i}, 6) AS {v}{i}" for i in K)


def _errors() -> str:
    """Frobenius norm over every cell that X or WH may fill, by the full product."""

    def norm(w: str, h: str, step: int) -> str:
        product = " + ".join(f"w{i} * h{i}" for i in K)
        return f"""SELECT {step} AS step, round(sqrt(sum((coalesce(x, 0) - ({product})) ** 2)), 5) AS error
FROM (SELECT doc_id, term_idx, {", ".join(f"w{i}, h{i}" for i in K)} FROM {w}, {h}) LEFT JOIN mat USING (doc_id, term_idx)"""

    rounds = CHECKED.max_rounds
    parts = [norm(f"w_{r}", f"h_{r - 1}", r) for r in range(1, rounds + 2)]
    parts.append(norm("w", f"h_{rounds}", rounds + 2))
    return " UNION ALL ".join(parts)


def _shared() -> str:
    pro = " UNION ALL ".join(f"SELECT {i} AS t, term, h{i} AS v FROM h_p" for i in K)
    con = " UNION ALL ".join(f"SELECT {i} AS t, term, h{i} AS v FROM h_c" for i in K)
    return f"""WITH {REVIEWS}, {_weights("pro", "_p")},
{_factors("_p")}, {_weights("con", "_c")},
{_factors("_c")},
p AS ({pro}), c AS ({con}),
pn AS (SELECT t, sqrt(sum(v * v)) AS norm FROM p GROUP BY t), cn AS (SELECT t, sqrt(sum(v * v)) AS norm FROM c GROUP BY t),
dots AS (SELECT p.t AS pt, c.t AS ct, sum(p.v * c.v) AS dot FROM p JOIN c USING (term) GROUP BY ALL),
cos AS (SELECT pn.t AS pt, cn.t AS ct, coalesce(dot / nullif(pn.norm * cn.norm, 0), 0) AS cosine
        FROM pn CROSS JOIN cn LEFT JOIN dots ON dots.pt = pn.t AND dots.ct = cn.t),
best AS (SELECT *, row_number() OVER (PARTITION BY pt ORDER BY cosine DESC, ct) AS r FROM cos)
SELECT pt AS pro_topic, ct AS con_topic, round(cosine, 6) AS cosine FROM best WHERE r = 1 AND cosine >= 0.3e0"""


def _bins(source: str, n: str) -> str:
    return f"""frame AS (SELECT CAST({n} AS BIGINT) AS bins, min(overall_rating) AS lo, max(overall_rating) AS hi FROM {source}),
counted AS (SELECT CAST(least(floor((overall_rating - lo) / ((hi - lo) / bins)), bins - 1) AS BIGINT) AS bin, count(*) AS n
            FROM {source}, frame GROUP BY 1)"""


BIN_ROWS = """SELECT b.bin, round(lo + (hi - lo) * b.bin / bins, 6) AS bin_low,
  round(lo + (hi - lo) * (b.bin + 1) / bins, 6) AS bin_high, coalesce(n, 0) AS n
FROM (SELECT unnest(range(bins)) AS bin, bins, lo, hi FROM frame) b LEFT JOIN counted USING (bin)"""


def _url(slug: str, suffix: str) -> str:
    return f"'https://reviews.example.com/Reviews/' || {slug} || '-Reviews-E' || company_id || {suffix} || '.htm'"


def oracle_sql() -> dict[str, str]:
    """SQL by query name. ``topic_sweep`` and ``polarity_topics`` run until they settle and have none."""
    side = "SELECT company_name, company_id, '{0}' AS side FROM {1} WHERE {2}"
    return {
        "employers_from_json": """SELECT p_partkey AS company_id, p_name AS company_name, p_size AS num_ratings,
            p_retailprice AS overall_rating, p_type AS recommend_pct, p_retailprice / 4 AS culture_rating,
            CAST(NULL AS DOUBLE) AS comp_rating, CAST(NULL AS DOUBLE) AS opportunity_rating,
            CAST(NULL AS DOUBLE) AS leader_rating, CAST(NULL AS DOUBLE) AS work_life_rating, p_brand AS industry
            FROM part""",
        "json_values": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
        "missing_pages": """WITH landed AS (SELECT page_id + 1 AS page_num, contains(html, '</html>') AS success FROM pages),
            seen AS (SELECT page_num, count(*) AS tries, bool_or(success) AS done FROM landed GROUP BY page_num),
            wanted AS (SELECT unnest(range(1, (SELECT max(page_num) FROM landed) + 6)) AS page_num)
            SELECT page_num, coalesce(tries, 0) AS tries, coalesce(tries, 0) < 5 AS retry
            FROM wanted LEFT JOIN seen USING (page_num) WHERE NOT coalesce(done, false)""",
        "employer_cutoffs": f"WITH {SELECTED} SELECT low, high FROM cut",
        "employers_tails": f"WITH {SELECTED} SELECT * FROM tails",
        "employers_middle": f"""WITH {SELECTED} SELECT big.* FROM big, cut
            WHERE NOT coalesce(overall_rating <= low, false) AND NOT coalesce(overall_rating >= high, false)""",
        "employers_good_bad": f"WITH {SELECTED}, m AS (SELECT avg(overall_rating) AS mean FROM tails) "
        + side.format("good", "tails, m", "overall_rating >= mean")
        + " UNION ALL "
        + side.format("bad", "tails, m", "overall_rating <= mean"),
        "work_batches": f"""WITH {SELECTED}, o AS (
            SELECT *, row_number() OVER (ORDER BY num_ratings, company_id) - 1 AS position FROM tails)
            SELECT company_name, company_id, position, position // 6 AS batch FROM o""",
        "rating_histogram": f"WITH {SELECTED}, {_bins('big', 'greatest(1, count(*) // 180)')} {BIN_ROWS}",
        "segmented_histogram": f"""SELECT 'middle' AS series, * FROM (WITH {SELECTED}, {_bins("big", "34")} {BIN_ROWS})
            UNION ALL SELECT 'tails' AS series, * FROM (WITH {SELECTED}, {_bins("tails", "34")} {BIN_ROWS})""",
        "chart_names": """SELECT p_partkey, replace(lower('Top ' || p_name || ' ' || p_brand || '.png'), ' ', '_') AS name
            FROM part""",
        "page_plan": f"""WITH {EMPLOYERS}, p AS (
            SELECT *, unnest(range(1, num_ratings // {PAGE_SIZE} + 2)) AS page FROM emp)
            SELECT company_id, company_name, CAST(page AS INTEGER) AS page,
            {_url("replace(company_name, ' ', '-')", "CASE WHEN page = 1 THEN '' ELSE '_P' || page END")} AS url FROM p""",
        "page_facts": f"""WITH {EMPLOYERS} SELECT company_id, CAST(num_ratings * 37 AS INTEGER) AS num_ratings,
            CAST(num_ratings % 11 AS INTEGER) AS page_size FROM emp""",
        "page_slugs": f"""WITH p AS (SELECT page_id AS company_id, {SLUG} AS slug FROM pages)
            SELECT company_id, slug, {_url("slug", "'_P2'")} AS url FROM p""",
        "blocked_pages": f"""WITH p AS (SELECT page_id AS company_id, {TITLE} AS title FROM pages)
            SELECT company_id, title, title = {_q(BLOCKED)} AS blocked FROM p""",
        "reviews_from_html": f"""WITH b AS (
              SELECT page_id AS company_id, url AS company_name,
                     CASE WHEN page_id % 2 = 0 THEN 'pro' ELSE 'con' END AS pro_or_con,
                     unnest(regexp_extract_all(html, '(?s)<article>(.*?)</article>', 1)) AS block FROM pages),
            p AS (SELECT *, ({PARAGRAPHS})[CASE WHEN pro_or_con = 'pro' THEN 4 ELSE 6 END] AS par FROM b)
            SELECT company_id, company_name, pro_or_con,
                   {_entities("(regexp_split_to_array(par, '</p>'))[1]")} AS review_text FROM p""",
        "reviews_clean": f"""WITH {REVIEWS} SELECT DISTINCT company_name, pro_or_con, review_text FROM fx
            WHERE review_text IS DISTINCT FROM 'That it.'""",
        "reviews_numbered": f"""WITH {REVIEWS}, c AS (
              SELECT company_name, pro_or_con, review_text, min(doc_id) AS doc_id FROM fx
              WHERE review_text IS DISTINCT FROM 'That it.' GROUP BY company_name, pro_or_con, review_text)
            SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id, company_name FROM c""",
        "reviews_row_ids": f"""WITH {REVIEWS}, c AS (
              SELECT DISTINCT company_name, pro_or_con, review_text FROM fx WHERE review_text IS DISTINCT FROM 'That it.'),
            both_ AS (SELECT * FROM c UNION ALL SELECT NULL, company_name, review_text FROM c WHERE pro_or_con IS NULL)
            SELECT company_name, pro_or_con, count(*) AS n_rows, count(*) AS n_ids FROM both_ GROUP BY ALL""",
        "coverage_check": f"{_coverage('company_name')} SELECT {CHECK_COLUMNS} FROM checked",
        "coverage_by_id": f"""{_coverage("company_id", ", CAST(substr(company_name, 4) AS BIGINT) AS company_id")}
            SELECT {CHECK_COLUMNS} FROM checked""",
        "recollect_lists": f"{_coverage('company_name')} "
        + side.format("pro", "checked", "delta_pct > 0.5 AND overall_rating > 3.5")
        + " UNION ALL "
        + side.format("con", "checked", "delta_pct > 0.5 AND overall_rating < 3.5"),
        "reviews_recollected": f"""WITH {REVIEWS}, u AS (
              SELECT * FROM fx WHERE company_name <> 'src1'
              UNION ALL SELECT * FROM fx WHERE company_name IN ('src1', 'src2'))
            SELECT min(doc_id) AS doc_id, company_name, pro_or_con FROM u
            WHERE review_text IS DISTINCT FROM 'That it.' GROUP BY company_name, pro_or_con, review_text""",
        "polarity_split": f"WITH {REVIEWS} SELECT doc_id, pro_or_con AS side FROM fx WHERE pro_or_con IN ('pro', 'con')",
        "text_tokens": f"""WITH {REVIEWS}, t AS (SELECT unnest({_tokens("review_text")}) AS token FROM fx)
            SELECT token, count(*) AS n FROM t GROUP BY token""",
        "lemma_tokens": f"{_lemmas(True)} SELECT doc_id, late, CAST(position AS INTEGER) AS position, lemma FROM lem",
        "lexicon_texts": f"""{_lemmas(True)} SELECT doc_id, coalesce(lemmatized_text, '') AS lemmatized_text
            FROM fx LEFT JOIN texts USING (doc_id)""",
        "lemmatized_text": f"""{_lemmas(False)} SELECT doc_id, pro_or_con, coalesce(lemmatized_text, '') AS lemmatized_text
            FROM fx LEFT JOIN texts USING (doc_id)""",
        "stem_counts": f"""WITH {REVIEWS}, t AS (SELECT unnest({TERMS}) AS term FROM fx)
            SELECT {_stem("term")} AS stem, count(*) AS n FROM t GROUP BY 1""",
        "ngram_counts": f"""WITH {REVIEWS}, l AS (SELECT {TERMS} AS w FROM fx),
            g AS (SELECT unnest({BIGRAMS}) AS ngram FROM l)
            SELECT ngram, count(*) AS n FROM g GROUP BY ngram""",
        "term_statistics": f"""WITH {REVIEWS}, t AS (SELECT doc_id, unnest({TERMS}) AS term FROM fx)
            SELECT term, count(DISTINCT doc_id) AS df, count(*) AS total FROM t GROUP BY term""",
        "vocabulary": f"WITH {REVIEWS}, {_weights()} SELECT term, term_idx, df, CAST(total AS BIGINT) AS total FROM voc",
        "tfidf_smooth": _weight_query(),
        "tfidf_plain": _weight_query(idf="ln(n / df)", normalize=False),
        "tfidf_max_features": _weight_query(max_df="0.5e0", max_features=50),
        "tfidf_bigrams": _weight_query(min_df=5, words=BIGRAMS),
        "top_terms_by_polarity": f"""WITH {REVIEWS}, {_weights()},
            s AS (SELECT pro_or_con, term, round(sum(x), 6) AS weight FROM mat JOIN fx USING (doc_id)
                  WHERE pro_or_con IS NOT NULL GROUP BY pro_or_con, term)
            SELECT *, row_number() OVER (PARTITION BY pro_or_con ORDER BY weight DESC, term) AS rank FROM s
            QUALIFY rank <= 20""",
        "nmf_start": f"{FIT} SELECT term_idx, {_vector('h')} FROM h_0",
        "nmf_certificate": f"""WITH {REVIEWS}, {_weights("pro")},
            keys_ AS (SELECT 'term' AS part, term AS key FROM voc
                      UNION ALL SELECT DISTINCT 'document', CAST(doc_id AS VARCHAR) FROM mat)
            SELECT topics, part, key, CAST(1 AS INTEGER) AS optimal FROM keys_, (VALUES (2), (3), (5)) AS k(topics)""",
        "nmf_documents": f"{FIT} SELECT doc_id, {_vector('w')} FROM w",
        "nmf_terms": f"{FIT} SELECT term, {_vector('h')} FROM h",
        "nmf_transform": f"""{FIT} SELECT doc_id, {", ".join(f"coalesce(round(w{i}, 6), 0) AS w{i}" for i in K)}
            FROM docs LEFT JOIN w USING (doc_id)""",
        "nmf_error": f"{FIT} {_errors()}",
        "topic_shares": f"{REPORT} SELECT doc_id, topic, round(pct, 6) AS pct FROM shares",
        "topic_labels": f"{REPORT} SELECT doc_id, topic, round(pct, 6) AS pct FROM labels_",
        "document_topics": f"""{REPORT} SELECT doc_id, coalesce(topics, '') AS topics FROM w LEFT JOIN (
              SELECT doc_id, string_agg(CAST(topic AS VARCHAR), ',' ORDER BY pct DESC, topic) AS topics
              FROM labels_ GROUP BY doc_id) USING (doc_id)""",
        "topic_words": f"{REPORT} SELECT topic, rank, term, round(weight, 6) AS weight FROM ranked WHERE rank <= 20",
        "topic_words_of_one": f"""{REPORT} SELECT topic, rank, term, round(weight, 6) AS weight FROM ranked
            WHERE rank <= 10 AND topic = 1""",
        "word_frequency": f"{REPORT} SELECT topic, term, round(frequency, 6) AS frequency FROM freq",
        "cloud_words": f"{REPORT} SELECT topic, rank, term, round(frequency, 6) AS frequency FROM cloud WHERE rank <= 150",
        "topic_sizes": f"{REPORT} SELECT topic, n_docs FROM sizes",
        "largest_topics": f"{REPORT} SELECT topic, n_docs FROM sizes ORDER BY n_docs DESC, topic LIMIT 2",
        "topic_summary": f"""{REPORT} SELECT s.topic, n_docs, string_agg(term, ' ' ORDER BY rank) AS words
            FROM sizes s LEFT JOIN ranked r ON r.topic = s.topic AND rank <= 20 GROUP BY s.topic, n_docs""",
        "topic_similarity": f"{REPORT} SELECT topic_a, topic_b, round(cosine, 6) AS cosine FROM cosines",
        "mean_similarity": f"{REPORT} SELECT {len(K)} AS topics, round(avg(cosine), 6) AS mean_cosine FROM cosines",
        "mean_similarity_of_columns": f"""{FIT},
            f AS (SELECT term_idx, {" + ".join(f"CAST(h{i} > 0 AS INTEGER)" for i in K)} AS filled FROM h
                  WHERE term_idx < {len(K)})
            SELECT {len(K)} AS topics, round(avg(a.filled * b.filled / {len(K) ** 2}e0), 6) AS mean_cosine
            FROM f a JOIN f b ON a.term_idx < b.term_idx""",
        "shared_topics": _shared(),
    }
