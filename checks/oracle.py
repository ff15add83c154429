"""SQL for DuckDB that states each registered query a second time.

The SQL follows the definitions, not the plans: neighbours come from window functions, counts
from plain grouping, quantiles from ``quantile_cont``.
"""

from __future__ import annotations

from checks import tables as t
from checks.queries import SELECTED_METRICS, SUPPORT, THRESHOLD
from corpuslens.data.patterns import PATTERN_GROUPS
from corpuslens.data.tables import EXAMPLES
from corpuslens.functions.text import SENTENCE_END, SILENT_E, TOKEN, VOWEL_RUN
from corpuslens.operators.entities import ENTITIES, NAMED, RULES
from corpuslens.operators.readability import GRADES, METRICS


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def values(rows) -> str:
    def cell(v):
        return str(v).lower() if isinstance(v, bool) else text(v) if isinstance(v, str) or v is None else repr(v)

    return "VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


def r6(expression: str) -> str:
    return f"round(({expression})::DOUBLE + 1e-9, 6) + 0.0"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


FIRST_100_TOKENS = r"^(?:[^\p{L}]*\p{L}+){100}"
PAIRS = """pairs AS (
  SELECT u.conv_id * 1000000 + u.turn AS row_id, s.text AS instruction,
         u.text AS prompt, a.text AS response
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN conversations s ON s.conv_id = u.conv_id AND s.turn = u.turn - 1 AND s.role = 'system'
  WHERE u.role = 'user')"""
DOCS = """docs AS (SELECT doc_id AS row_id, 'document' AS field, text FROM documents)"""
CORPUS = """corpus AS (
  SELECT row_id, 'prompt' AS field, prompt AS text FROM pairs
  UNION ALL SELECT row_id, 'response', response FROM pairs
  UNION ALL SELECT * FROM docs)"""
BASE = (PAIRS, DOCS, CORPUS)
INLINE = f"""inline_rows(row_id, field, text) AS ({values([(i, "inline", x) for i, x in enumerate(t.INLINE)])}),
everything AS (SELECT * FROM corpus UNION ALL SELECT * FROM inline_rows)"""


def tokenized(source: str, name: str = "tok") -> str:
    return f"""{name} AS (
  SELECT row_id, field, text, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM {source})"""


TOK = tokenized("corpus")
WORDS = """words AS (
  SELECT row_id, field, unnest(t) AS token, unnest(range(1, len(t) + 1)) AS pos FROM tok)"""
TF = """tf AS (SELECT row_id, field, token, count(*) AS tf FROM words GROUP BY ALL)"""

# Sources and columns

PLAIN = with_(PAIRS) + "SELECT row_id, prompt, response FROM pairs"


def sentiment_ctes() -> tuple[str, ...]:
    tokens = sorted({*t.WEIGHTS, *t.BOOSTERS, *t.NEGATIONS})
    lexicon = values(
        [(w, t.WEIGHTS.get(w), t.BOOSTERS.get(w, 0.0), w in t.NEGATIONS) for w in tokens]
    )
    return (
        f"lexicon(token, weight, boost, negates) AS ({lexicon})",
        """before AS (
  SELECT row_id, field, token, lag(token, 1) OVER w AS b1, lag(token, 2) OVER w AS b2,
         lag(token, 3) OVER w AS b3
  FROM words WINDOW w AS (PARTITION BY row_id, field ORDER BY pos))""",
        """valued AS (
  SELECT x.row_id, x.field,
    (l.weight + CASE WHEN l.weight > 0 THEN 1 ELSE -1 END
       * (coalesce(m1.boost, 0) + 0.95 * coalesce(m2.boost, 0) + 0.9 * coalesce(m3.boost, 0)))
    * CASE WHEN coalesce(m1.negates, false) OR coalesce(m2.negates, false)
                OR coalesce(m3.negates, false) THEN -0.74 ELSE 1 END AS v
  FROM before x JOIN lexicon l ON l.token = x.token AND l.weight IS NOT NULL
  LEFT JOIN lexicon m1 ON m1.token = x.b1
  LEFT JOIN lexicon m2 ON m2.token = x.b2
  LEFT JOIN lexicon m3 ON m3.token = x.b3)""",
        "total AS (SELECT row_id, field, sum(v) AS s FROM valued GROUP BY ALL)",
        f"""sentiment AS (
  SELECT c.row_id, c.field, CASE WHEN c.text IS NOT NULL THEN
    {r6("coalesce(s, 0) / sqrt(coalesce(s, 0) * coalesce(s, 0) + 15)")} END AS sentiment
  FROM corpus c LEFT JOIN total USING (row_id, field))""",
    )


SENTIMENT = sentiment_ctes()

TOXICITY_LEXICON = (
    "labelled AS (SELECT docs.row_id, text, toxic FROM docs JOIN labels ON row_id = doc_id WHERE toxic IS NOT NULL)",
    "counts AS (SELECT sum(toxic) AS tt, sum(1 - toxic) AS ff FROM labelled)",
    f"""presence AS (
  SELECT DISTINCT row_id, toxic, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS token
  FROM labelled)""",
    "per_token AS (SELECT token, sum(toxic) AS t, sum(1 - toxic) AS f FROM presence GROUP BY token)",
    f"""toxic_words AS (
  SELECT token, ln((t + 1) / (tt + 2)) - ln((f + 1) / (ff + 2)) AS log_odds,
         coalesce(ln(tt / nullif(ff, 0)), 0) AS prior
  FROM per_token, counts
  WHERE t >= {SUPPORT} AND ln((t + 1) / (tt + 2)) - ln((f + 1) / (ff + 2)) >= {THRESHOLD})""",
)
TOXICITY = (
    *TOXICITY_LEXICON,
    """evidence AS (
  SELECT row_id, field, sum(log_odds) + max(prior) AS e
  FROM (SELECT DISTINCT row_id, field, token FROM words) JOIN toxic_words USING (token)
  GROUP BY ALL)""",
    f"""toxicity AS (
  SELECT c.row_id, c.field,
    CASE WHEN c.text IS NOT NULL THEN {r6("coalesce(1 / (1 + exp(-e)), 0)")} END AS toxicity
  FROM corpus c LEFT JOIN evidence USING (row_id, field))""",
)

SHIPPED = [(g, -1 - i, x) for g, texts in EXAMPLES.items() for i, x in enumerate(texts)]
KNOWN = f"""known(grp, example_id, text) AS (
  {values(SHIPPED)}
  UNION ALL SELECT 'injection', item_id, text FROM benchmark
  UNION ALL SELECT 'jailbreak', conv_id, text FROM conversations WHERE role = 'user' AND turn = 1
  UNION ALL SELECT 'refusal', conv_id, text FROM conversations WHERE role = 'assistant' AND turn = 2)"""


def shingle_of(source: str, key: str, name: str) -> str:
    return f"""{name} AS (
  SELECT DISTINCT {key}, unnest([t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] for i in range(1, len(t) - 1)]) AS shingle
  FROM {source})"""


SHINGLES = (
    KNOWN,
    f"known_tok AS (SELECT grp, example_id, regexp_extract_all(lower(text), '{TOKEN}') AS t FROM known)",
    shingle_of("known_tok", "grp, example_id", "known_shingles"),
    "sizes AS (SELECT grp, example_id, count(*) AS size FROM known_shingles GROUP BY ALL)",
    shingle_of("tok", "row_id, field", "text_shingles"),
    """shares AS (
  SELECT row_id, field, grp, example_id, count(*) AS shared
  FROM text_shingles JOIN known_shingles USING (shingle) GROUP BY ALL)""",
    """best AS (
  SELECT row_id, field, grp, max(shared / size) AS score
  FROM shares JOIN sizes USING (grp, example_id) GROUP BY ALL)""",
)


def shingle_query(where: str, *groups: str) -> str:
    columns = ", ".join(
        f"{r6(f'''coalesce((SELECT score FROM best b WHERE b.row_id = c.row_id AND b.field = c.field AND grp = '{g}'), 0)''')} AS {g}"
        for g in groups
    )
    return with_(*BASE, TOK, *SHINGLES) + f"SELECT row_id, field, {columns} FROM corpus c WHERE {where}"


TFIDF = (
    KNOWN,
    f"""ex_words AS (
  SELECT example_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS token
  FROM (SELECT lower(text) AS text, min(example_id) AS example_id FROM known WHERE grp = 'injection' GROUP BY 1))""",
    "ex_tf AS (SELECT example_id, token, count(*) AS tf FROM ex_words GROUP BY ALL)",
    "ex_n AS (SELECT count(DISTINCT example_id) AS n FROM ex_tf)",
    """idf AS (
  SELECT token, ln((1 + max(n)) / (1 + count(*))) + 1 AS idf FROM ex_tf, ex_n
  GROUP BY token)""",
    "ex_w AS (SELECT example_id, token, tf * idf AS w FROM ex_tf JOIN idf USING (token))",
    "ex_norm AS (SELECT example_id, sqrt(sum(w * w)) AS norm FROM ex_w GROUP BY ALL)",
    "row_w AS (SELECT row_id, field, token, tf * idf AS w FROM tf JOIN idf USING (token))",
    "row_norm AS (SELECT row_id, field, sqrt(sum(w * w)) AS norm FROM row_w GROUP BY ALL)",
    """cosines AS (
  SELECT row_id, field, example_id, sum(a.w * b.w) AS dot
  FROM row_w a JOIN ex_w b USING (token) GROUP BY ALL)""",
    """nearest AS (
  SELECT row_id, field, max(dot / e.norm / r.norm) AS score
  FROM cosines JOIN ex_norm e USING (example_id) JOIN row_norm r USING (row_id, field) GROUP BY ALL)""",
)

DENSE = f"""WITH parts AS (
  SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings),
means AS (SELECT label, pos, avg(x) AS x FROM parts GROUP BY ALL),
centers AS (SELECT label, list(x ORDER BY pos) AS c FROM means GROUP BY label)
SELECT vec_id, {r6("max(list_cosine_similarity(embedding::DOUBLE[], c))")} AS theme
FROM embeddings, centers GROUP BY vec_id"""


def topic_ctes(words: dict) -> tuple[str, ...]:
    return (
        *BASE,
        TOK,
        WORDS,
        TF,
        f"topics(topic, token, weight) AS ({values(t.topic_rows(words))})",
        "norms AS (SELECT row_id, field, sqrt(sum(tf * tf)) AS norm FROM tf GROUP BY ALL)",
        "per_topic AS (SELECT row_id, field, topic, sum(weight * tf) AS s FROM tf JOIN topics USING (token) GROUP BY ALL)",
        """ranked AS (
  SELECT row_id, field, topic, s,
         row_number() OVER (PARTITION BY row_id, field ORDER BY s DESC, topic) AS place
  FROM per_topic)""",
        f"""closest AS (
  SELECT c.row_id, c.field, topic, {r6("s / norm")} AS score
  FROM corpus c LEFT JOIN ranked x ON x.row_id = c.row_id AND x.field = c.field AND place = 1
  LEFT JOIN norms n ON n.row_id = c.row_id AND n.field = c.field)""",
    )


# Patterns. The first group uses look-around, so its conditions are spelled out here.

_SSN_SHAPE = r"\b\d{3}[- ]?\d{2}[- ]?\d{4}\b"
_SSN_PARTS = r"^(\d{3})([- ]?)(\d{2})([- ]?)(\d{4})$"


def _ssn_part(i: int) -> str:
    return f"regexp_extract(m, '{_SSN_PARTS}', {i})"


SSN = f"""len(list_filter(regexp_extract_all(text, '{_SSN_SHAPE}'), lambda m:
  {_ssn_part(2)} = {_ssn_part(4)} AND {_ssn_part(1)} NOT IN ('666', '000')
  AND {_ssn_part(1)}[1] <> '9' AND {_ssn_part(3)} <> '00' AND {_ssn_part(5)} <> '0000'
  AND {_ssn_part(3)} || {_ssn_part(5)} <> repeat({_ssn_part(1)}[3], 6))) > 0"""


def matches(expression: str) -> str:
    return SSN if expression == PATTERN_GROUPS[0][1] else f"regexp_matches(text, {text(expression)})"


def first_pattern(groups) -> str:
    return "CASE " + " ".join(f"WHEN {matches(e)} THEN {text(n)}" for n, e in groups) + " END"


LABELLED = f"labelled_rows AS (SELECT row_id, field, {first_pattern(PATTERN_GROUPS)} AS pattern FROM everything)"
PATTERN_BASE = (*BASE, INLINE)

# Entities


def _weighted(weights: list[int]) -> str:
    return f"list_sum(list_transform({_DIGITS}, lambda d, i: d * ({weights})[i]))"


_DIGITS = "list_transform(regexp_extract_all(m, '[0-9]'), lambda c: c::INT)"
CHECKS = {
    "CREDIT_CARD": f"""list_sum(list_transform({_DIGITS}, lambda d, i:
      CASE WHEN (len(regexp_extract_all(m, '[0-9]')) - i) % 2 = 0 THEN d
           WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END)) % 10 = 0""",
    "AU_ABN": f"({_weighted([10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19])} - 10) % 89 = 0",
    "AU_ACN": f"(10 - {_weighted([8, 7, 6, 5, 4, 3, 2, 1, 0])} % 10) % 10 = ({_DIGITS})[9]",
    "AU_TFN": f"{_weighted([1, 4, 3, 7, 5, 8, 6, 9, 10])} % 11 = 0",
    "UK_NHS": f"(11 - {_weighted([10, 9, 8, 7, 6, 5, 4, 3, 2, 0])} % 11) % 11 = ({_DIGITS})[10]",
    "MEDICAL_LICENSE": f"{_weighted([1, 2, 1, 2, 1, 2, 0])} % 10 = ({_DIGITS})[7]",
    "IBAN_CODE": """list_reduce(list_prepend(0, list_transform(
        regexp_extract_all(substr(m, 5) || substr(m, 1, 4), '[A-Z0-9]'),
        lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ord(c) - 48 ELSE ord(c) - 55 END)),
      lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1""",
}


def finding(entity: str) -> str:
    rule = RULES[entity]
    found = f"regexp_extract_all(text, {text(rule.expression)})"
    if rule.shorter:
        less = f"regexp_extract(m, {text(rule.shorter)}, 1)"
        found = f"list_transform({found}, lambda m: CASE WHEN {CHECKS[entity]} THEN m ELSE {less} END)"
    if entity in CHECKS:
        found = f"list_filter({found}, lambda m: {CHECKS[entity]})"
    if rule.context:
        found = f"CASE WHEN regexp_matches(text, {text(rule.context)}) THEN {found} ELSE [] END"
    return f"""SELECT row_id, field, {text(entity)} AS entity, unnest({found}) AS text,
  unnest(range(len({found}))) AS nth, {ENTITIES.index(entity)} AS ord, {rule.score}::DOUBLE AS score
  FROM everything WHERE text IS NOT NULL"""


def shapes(selected=None) -> str:
    chosen = [e for e in ENTITIES if e in RULES and (not selected or e in selected)]
    return "shapes AS (\n" + "\nUNION ALL ".join(finding(e) for e in chosen) + ")"


def gazetteer() -> tuple[str, ...]:
    rows = [(e, name) for e in NAMED for name in t.GAZETTEER[e]]
    return (
        tokenized("everything"),
        WORDS,
        """grams AS (
  SELECT row_id, field, token AS n1, lead(token, 1) OVER w AS n2, lead(token, 2) OVER w AS n3
  FROM words WINDOW w AS (PARTITION BY row_id, field ORDER BY pos))""",
        f"names(entity, name) AS ({values(rows)})",
        """named AS (
  SELECT row_id, field, entity, lower(name) AS text, 0.4::DOUBLE AS score
  FROM grams JOIN names ON lower(name) IN (n1, n1 || ' ' || n2, n1 || ' ' || n2 || ' ' || n3))""",
    )


# The shape rules look for digits first; ordering within a text follows the catalogue, with the
# three shapes that may lack digits in front.
SHAPE_ORDER = "entity NOT IN ('EMAIL_ADDRESS', 'URL', 'IP_ADDRESS'), ord, nth"

# Text statistics


def syllables(word: str) -> str:
    runs = f"len(regexp_extract_all({word}, '{VOWEL_RUN}'))"
    silent = f"CASE WHEN {runs} > 1 AND regexp_matches({word}, '{SILENT_E}') THEN 1 ELSE 0 END"
    return f"greatest(1, {runs} - {silent})"


def sentences(expression: str) -> str:
    return f"greatest(1, len(regexp_extract_all({expression}, '{SENTENCE_END}')))"


COMMON = f"""common AS (
  SELECT token, count(*) AS documents
  FROM (SELECT DISTINCT row_id, field, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS token FROM corpus)
  GROUP BY token ORDER BY documents DESC, token LIMIT 3000)"""


def counts(source: str) -> tuple[str, ...]:
    return (
        COMMON,
        tokenized(f"(SELECT row_id, field, nullif(text, '') AS text FROM {source})", "given"),
        f"""syl AS (
  SELECT *, list_transform(t, lambda w: {syllables("w")}) AS y FROM given)""",
        f"""hard AS (
  SELECT row_id, field, count(DISTINCT w) AS difficult
  FROM (SELECT row_id, field, unnest(t) AS w, unnest(y) AS n FROM syl)
  WHERE n >= 2 AND w NOT IN (SELECT token FROM common) GROUP BY ALL)""",
        f"""counted AS (
  SELECT s.row_id, s.field,
    len(t) AS words,
    CASE WHEN text IS NOT NULL THEN {sentences("text")} END AS sentences,
    CASE WHEN text IS NOT NULL THEN coalesce(list_sum(y), 0) END::BIGINT AS syllables,
    length(regexp_replace(text, '\\s', '', 'g')) AS characters,
    CASE WHEN text IS NOT NULL THEN coalesce(list_sum(list_transform(t, lambda w: length(w))), 0) END::BIGINT AS letters,
    len(list_filter(y, lambda n: n >= 3)) AS polysyllables,
    len(list_filter(y, lambda n: n = 1)) AS monosyllables,
    len(t[1:100]) AS first_words,
    len(list_filter(y[1:100], lambda n: n >= 3)) AS first_hard,
    CASE WHEN text IS NULL THEN NULL WHEN len(t) <= 100 THEN {sentences("text")}
         ELSE {sentences(f"regexp_extract(text, '{FIRST_100_TOKENS}')")} END AS first_sentences,
    CASE WHEN text IS NOT NULL THEN coalesce(difficult, 0) END AS difficult
  FROM syl s LEFT JOIN hard h ON h.row_id = s.row_id AND h.field = s.field)""",
    )


def statistic_ctes(source: str, exact: bool = False) -> tuple[str, ...]:
    w = "nullif(words, 0)::DOUBLE"
    formulas = {
        "Flesch Reading Ease": f"206.835 - 1.015 * words / sentences - 84.6 * syllables / {w}",
        "SMOG Index": "CASE WHEN sentences >= 3 THEN 1.0430 * sqrt(30 * polysyllables / sentences) + 3.1291 END",
        "Flesch-Kincaid Grade Level": f"0.39 * words / sentences + 11.8 * syllables / {w} - 15.59",
        "Coleman-Liau Index": f"5.88 * letters / {w} - 29.6 * sentences / {w} - 15.8",
        "Automated Readability Index": f"4.71 * characters / {w} + 0.5 * words / sentences - 21.43",
        "Dale-Chall Readability Score": f"""15.79 * difficult / {w} + 0.0496 * words / sentences
          + CASE WHEN 100 * difficult / {w} > 5 THEN 3.6365 ELSE 0 END""",
        "Difficult Words": "difficult",
        "Linsear Write Formula": """CASE WHEN first_words = 0 THEN NULL
          WHEN (first_words + 2 * first_hard) / first_sentences > 20
          THEN (first_words + 2 * first_hard) / first_sentences / 2
          ELSE ((first_words + 2 * first_hard) / first_sentences - 2) / 2 END""",
        "Gunning Fog Index": f"0.4 * (words / sentences + 100 * polysyllables / {w})",
        "Lexicon Count": "words",
        "Sentence Count": "sentences",
        "Syllable Count": "syllables",
        "Character Count": "characters",
        "Polysyllable Count": "polysyllables",
        "Monosyllable Count": "monosyllables",
    }
    columns = ",\n    ".join(f'({f})::DOUBLE AS "{m}"' for m, f in formulas.items())
    grades = " UNION ALL ".join(f'SELECT row_id, field, round("{g}") AS g FROM raw' for g in GRADES)
    quoted = [f'"{m}"' for m in METRICS]
    chosen = ",\n    ".join(f"{name if exact else r6(name)} AS {name}" for name in quoted)
    return (
        *counts(source),
        f"raw AS (SELECT row_id, field,\n    {columns}\n  FROM counted)",
        f"votes AS (SELECT row_id, field, g, count(*) AS n FROM ({grades}) WHERE g IS NOT NULL GROUP BY ALL)",
        """standard AS (
  SELECT row_id, field, g FROM votes
  QUALIFY row_number() OVER (PARTITION BY row_id, field ORDER BY n DESC, g) = 1)""",
        f"""statistics AS (
  SELECT row_id, field, {chosen}
  FROM (SELECT r.*, s.g AS "Text Standard" FROM raw r
        LEFT JOIN standard s ON s.row_id = r.row_id AND s.field = r.field))""",
    )


def unpivoted(metrics) -> str:
    return " UNION ALL ".join(
        f"""SELECT row_id, field, {text(m)} AS metric, "{m}" AS value FROM statistics""" for m in metrics
    )


# Summaries

SCORES = (
    *BASE,
    TOK,
    WORDS,
    *SENTIMENT,
    *TOXICITY,
    """scores AS (
  SELECT row_id, field, 'sentiment' AS metric, sentiment AS value FROM sentiment
  UNION ALL SELECT row_id, field, 'toxicity', toxicity FROM toxicity)""",
)
BARS = """ranges AS (
  SELECT field, metric, min(value) AS lo, max(value) AS hi FROM scores
  WHERE value IS NOT NULL GROUP BY ALL),
binned AS (
  SELECT field, metric, lo, hi,
    CASE WHEN hi > lo THEN least(floor((value - lo) / (hi - lo) * 50) + 1, 50) ELSE 1 END AS bin
  FROM scores JOIN ranges USING (field, metric) WHERE value IS NOT NULL),
bars AS (
  SELECT field, metric, bin::INT AS bin, lo + (bin - 1) * ((hi - lo) / 50) AS low,
    CASE WHEN bin = 50 THEN hi ELSE lo + bin * ((hi - lo) / 50) END AS high, count(*) AS n
  FROM binned GROUP BY field, metric, lo, hi, bin)"""
BAR_COLUMNS = f"field, metric, bin, {r6('low')} AS low, {r6('high')} AS high, n"
SUMMARY = f"""SELECT field, metric, count(value) AS n, {r6("max(value)")} AS max,
  {r6("avg(value)")} AS mean, {r6("stddev_samp(value)")} AS std FROM scores GROUP BY field, metric"""
QUARTILES = f"""SELECT field, metric, {r6("a")} AS least, {r6("b")} AS q1, {r6("c")} AS median,
  {r6("d")} AS q3, {r6("e")} AS most, {r6("b - 1.5 * (d - b)")} AS lower_fence,
  {r6("d + 1.5 * (d - b)")} AS upper_fence
FROM (SELECT field, metric, min(value) AS a, quantile_cont(value, 0.25) AS b,
        quantile_cont(value, 0.5) AS c, quantile_cont(value, 0.75) AS d, max(value) AS e
      FROM scores WHERE value IS NOT NULL GROUP BY field, metric)"""
DENSITY = f""", stats AS (
  SELECT field, metric, count(value) AS total, min(value) AS lo, max(value) AS hi,
         1.06 * stddev_samp(value) * pow(count(value), -0.2) AS h
  FROM scores GROUP BY ALL HAVING max(value) > min(value)),
grid AS (SELECT *, lo + (hi - lo) * point / 100 AS x FROM stats, range(101) r(point))
SELECT g.field, g.metric, point::INT AS point, {r6("x")} AS x,
  {r6("sum(n * exp(-pow((x - (low + high) / 2) / h, 2) / 2)) / (total * h * sqrt(2 * pi()))")} AS density
FROM grid g JOIN bars b ON b.field = g.field AND b.metric = g.metric
GROUP BY g.field, g.metric, point, x, total, h"""


def top(source: str, label: str) -> str:
    return f"""SELECT f.field, coalesce({label}, 'None') AS {label}, coalesce(n, 0) AS n
FROM (SELECT DISTINCT field FROM {source}) f
LEFT JOIN (
  SELECT field, {label}, count(*) AS n FROM {source} WHERE {label} IS NOT NULL GROUP BY field, {label}
  QUALIFY row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, min(row_id), {label}) = 1) USING (field)"""


FINDINGS = (*PATTERN_BASE, shapes())
TOP_ENTITIES = f"""SELECT f.field, coalesce(entities, 'None') AS entities, coalesce(n, 0) AS n
FROM (SELECT DISTINCT field FROM everything) f
LEFT JOIN (
  SELECT field, string_agg(entity, ', ' ORDER BY first, place, entity) AS entities, max(n) AS n
  FROM (
    SELECT field, entity, count(*) AS n, min(row_id) AS first,
           arg_min(place, (row_id, place)) AS place
    FROM (SELECT *, row_number() OVER (PARTITION BY row_id, field ORDER BY {SHAPE_ORDER}) AS place
          FROM shapes)
    GROUP BY field, entity QUALIFY rank() OVER (PARTITION BY field ORDER BY count(*) DESC) = 1)
  GROUP BY field) USING (field)"""


CORPUS_STATISTICS = (*BASE, *statistic_ctes("corpus"))


def stream_scores() -> str:
    pattern = f"patterned AS (SELECT row_id, field, {first_pattern(PATTERN_GROUPS)} AS pattern FROM corpus)"
    found = f"everything AS (SELECT * FROM corpus), {shapes()}"
    return (
        with_(*CORPUS_STATISTICS, pattern, found)
        + """SELECT s.*, p.pattern, coalesce(n, 0)::INT AS n_entities FROM statistics s
JOIN patterned p USING (row_id, field)
LEFT JOIN (SELECT row_id, field, count(*) AS n FROM shapes GROUP BY ALL) e USING (row_id, field)"""
    )


def stream_summary() -> str:
    scores = f"scores AS ({unpivoted(METRICS)})"
    return with_(*BASE, *statistic_ctes("corpus", exact=True), scores) + SUMMARY


def stream_foreach_batch() -> str:
    topics = [c for c in topic_ctes(t.TOPICS) if c not in (*BASE, TOK, WORDS)]
    shingles = shingle_query("true", "injection")[len(with_(*BASE, TOK, *SHINGLES)) :]
    return (
        with_(*BASE, TOK, WORDS, *SENTIMENT, *TOXICITY, *topics, *SHINGLES, f"copied AS ({shingles})")
        + """SELECT row_id, field, sentiment, toxicity, injection, topic FROM sentiment
JOIN toxicity USING (row_id, field) JOIN copied USING (row_id, field) JOIN closest USING (row_id, field)"""
    )


def readability_wide() -> str:
    sides = ", ".join(
        f'''max("{m}") FILTER (field = '{f}') AS "{f.capitalize()} {m}"'''
        for f in ("prompt", "response")
        for m in METRICS
    )
    source = "(SELECT * FROM corpus WHERE field <> 'document')"
    return with_(*BASE, *statistic_ctes(source)) + f"SELECT row_id, {sides} FROM statistics GROUP BY row_id"


STATISTICS = (*BASE, INLINE, *statistic_ctes("everything"))

ORACLE = {
    "read_csv_pairs": PLAIN,
    "read_tsv_pairs": PLAIN,
    "read_json_pairs": PLAIN,
    "read_split_pairs": PLAIN + " WHERE length(prompt) % 4 <> 0",
    "load_precedence": PLAIN,
    "dataset_view": with_(PAIRS) + "SELECT * FROM pairs",
    "export_display_headers": with_(PAIRS)
    + f"""SELECT row_id, prompt AS "Prompt", response AS "Response",
  {first_pattern(PATTERN_GROUPS).replace("text", "prompt")} AS "Prompt Patterns",
  {first_pattern(PATTERN_GROUPS).replace("text", "response")} AS "Response Patterns" FROM pairs""",
    "normalize_columns": PLAIN,
    "compose_prompt": with_(PAIRS)
    + """SELECT row_id, instruction, prompt AS input, response,
  instruction || '. ' || prompt AS prompt FROM pairs""",
    "unwrap_scores": f"""SELECT doc_id,
  CASE WHEN lang <> 'de' THEN {r6("n_chars / 1000")} END AS score FROM documents""",
    "sentiment_compound": with_(*BASE, TOK, WORDS, *SENTIMENT) + "SELECT * FROM sentiment",
    "toxicity_lexicon": with_(DOCS, *TOXICITY_LEXICON)
    + f"SELECT token, {r6('log_odds')} AS log_odds, {r6('prior')} AS prior FROM toxic_words",
    "toxicity_score": with_(*BASE, TOK, WORDS, *TOXICITY) + "SELECT * FROM toxicity",
    "injection_score": shingle_query("field <> 'response'", "injection"),
    "jailbreak_score": shingle_query("field = 'prompt'", "jailbreak"),
    "refusal_score": shingle_query("field = 'response'", "refusal"),
    "similarity_shingle": shingle_query("true", "injection", "jailbreak", "refusal"),
    "similarity_tfidf": with_(*BASE, TOK, WORDS, TF, *TFIDF)
    + f"""SELECT c.row_id, c.field, {r6("coalesce(score, 0)")} AS injection
FROM corpus c LEFT JOIN nearest USING (row_id, field)""",
    "similarity_dense": DENSE,
    "topic_closest": with_(*topic_ctes(t.TOPICS)) + "SELECT * FROM closest",
    "topic_custom": with_(*topic_ctes(t.CUSTOM_TOPICS)) + "SELECT * FROM closest",
    "topic_terms": with_(*BASE, TOK, WORDS)
    + f"""SELECT token, documents, {r6("ln((1 + n) / (1 + documents)) + 1")} AS idf
FROM (SELECT token, count(DISTINCT (row_id, field)) AS documents FROM words GROUP BY token),
  (SELECT count(*) AS n FROM tok WHERE len(t) > 0)""",
    "pattern_label": with_(*PATTERN_BASE, LABELLED) + "SELECT * FROM labelled_rows",
    "pattern_custom": with_(*PATTERN_BASE)
    + f"SELECT row_id, field, {first_pattern(t.CUSTOM_PATTERNS)} AS pattern FROM everything",
    "pattern_hits": with_(*PATTERN_BASE)
    + " UNION ALL ".join(
        f'SELECT row_id, field, {text(n)} AS "group" FROM everything WHERE {matches(e)}'
        for n, e in PATTERN_GROUPS
    ),
    "pii_entities": with_(*FINDINGS, *gazetteer())
    + """SELECT row_id, field, entity, text, score FROM shapes
UNION ALL SELECT row_id, field, entity, text, score FROM named""",
    "pii_selected": with_(*PATTERN_BASE, shapes(t.SELECTED))
    + "SELECT row_id, field, entity, text, score FROM shapes",
    "pii_rendered": with_(*FINDINGS)
    + f"""SELECT c.row_id, c.field, coalesce(entities, '') AS entities FROM everything c
LEFT JOIN (SELECT row_id, field, string_agg(entity || ': ' || text, ', ' ORDER BY {SHAPE_ORDER}) AS entities
           FROM shapes GROUP BY ALL) USING (row_id, field)""",
    "common_words": with_(*BASE, COMMON) + "SELECT * FROM common",
    "readability_counts": with_(*BASE, INLINE, *counts("everything")) + "SELECT * FROM counted",
    "readability_scores": with_(*STATISTICS) + "SELECT * FROM statistics",
    "readability_wide": readability_wide(),
    "readability_selected": with_(*STATISTICS) + unpivoted(SELECTED_METRICS),
    "readability_histogram": with_(*STATISTICS, f"scores AS ({unpivoted(METRICS)})", BARS)
    + f"SELECT {BAR_COLUMNS} FROM bars",
    "score_summary": with_(*SCORES) + SUMMARY,
    "score_histogram": with_(*SCORES, BARS) + f"SELECT {BAR_COLUMNS} FROM bars",
    "score_quartiles": with_(*SCORES) + QUARTILES,
    "score_density": with_(*SCORES, BARS).rstrip() + DENSITY,
    "topic_counts": with_(*topic_ctes(t.TOPICS))
    + "SELECT field, topic, count(*) AS n FROM closest GROUP BY ALL",
    "topic_top": with_(*topic_ctes(t.TOPICS)) + top("closest", "topic"),
    "pattern_counts": with_(*PATTERN_BASE, LABELLED)
    + "SELECT field, pattern, count(*) AS n FROM labelled_rows GROUP BY ALL",
    "pattern_top": with_(*PATTERN_BASE, LABELLED) + top("labelled_rows", "pattern"),
    "pii_counts": with_(*FINDINGS, *gazetteer())
    + """SELECT field, entity, count(*) AS n FROM (
  SELECT field, entity FROM shapes UNION ALL SELECT field, entity FROM named) GROUP BY ALL""",
    "pii_counts_filled": with_(*FINDINGS)
    + """SELECT f.field, coalesce(entity, 'No Entities') AS entity, coalesce(n, 0) AS n
FROM (SELECT DISTINCT field FROM everything) f
LEFT JOIN (SELECT field, entity, count(*) AS n FROM shapes GROUP BY ALL) USING (field)""",
    "pii_top": with_(*FINDINGS) + TOP_ENTITIES,
    "table_sort": with_(*BASE, TOK, WORDS, *SENTIMENT)
    + "SELECT * FROM sentiment ORDER BY sentiment DESC, row_id, field",
    "table_filter": """SELECT doc_id, lang, source, n_chars FROM documents
WHERE lang <> 'de' AND n_chars >= 1000 AND contains(text, 'on the')""",
    "table_page": PLAIN + " ORDER BY row_id LIMIT 10 OFFSET 20",
    "stream_scores": stream_scores(),
    "stream_summary": stream_summary(),
    "stream_foreach_batch": stream_foreach_batch(),
}
