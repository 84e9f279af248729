"""The registered queries in SQL, written without regard to the Spark plans.

A query is a chain of named common table expressions; ``sql`` picks the ones it needs.
"""

from __future__ import annotations

import re

from topicvote.constants import (
    DELETED_CHARACTERS,
    GATES,
    SAMPLE_DELTA,
    SAMPLE_MINIMUM,
    SAMPLE_Z,
    STOPWORDS,
    TOPIC_NAMES,
    TOPICS,
    VARIANT_NAMES,
)

P = 2147483647
SEED = "1830"
FOLD = 3
SMOOTHING = 0.1
SPACE = r"[ \t\n\x0B\f\r]+"
WORD_OR_GAP = r"[\p{L}\p{N}_]+(?:''[\p{L}\p{N}_]+)*|[^\p{L}\p{N}_]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


STOP_LIST = "[" + ", ".join(quoted(w) for w in STOPWORDS) + "]"
TOPIC_ROWS = ", ".join(f"({t})" for t in TOPICS)
NAME_ROWS = ", ".join(f"({t}, {quoted(f'{t}. {n}')})" for t, n in TOPIC_NAMES.items())


def hashed(key: str, length: int = 15, start: int = 1) -> str:
    return f"('0x' || substr(md5({key}), {start}, {length}))::BIGINT"


def row_hash(key: str = "doc_id") -> str:
    return f"{hashed(quoted(SEED + '|') + f' || {key}')} % {P}"


BASE: list[tuple[str, str]] = [
    (
        "raw_corpus",
        """SELECT doc_id, text, doc_id % 3 + 1 AS sim,
                  CASE WHEN src % 7 = 0 THEN 20 WHEN src = 13 THEN 16 WHEN lang = 'en' THEN 1
                       WHEN lang = 'de' THEN 4 WHEN lang = 'es' THEN 12 ELSE 103 END AS majortopic
           FROM (SELECT *, CAST(regexp_extract(source, '[0-9]+') AS INT) AS src FROM documents)""",
    ),
    (
        "corpus",
        """SELECT doc_id, text, sim, CASE WHEN majortopic > 23 THEN 100 ELSE majortopic END AS label
           FROM raw_corpus""",
    ),
    ("topics", f"SELECT * FROM (VALUES {TOPIC_ROWS}) AS t(topic)"),
    ("names", f"SELECT * FROM (VALUES {NAME_ROWS}) AS t(topic, category)"),
    (
        "tokens",
        rf"""SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '{SPACE}'),
                                              lambda w: length(w) >= 2 OR bit_length(w) >= 32)) AS term FROM corpus""",
    ),
    ("all_terms", "SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL"),
    (
        "vocab",
        """SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tc FROM all_terms GROUP BY term
           HAVING count(*) >= 5 ORDER BY tc DESC, term LIMIT 262144""",
    ),
    (
        "weights",
        "SELECT term, ln(((SELECT count(*) FROM corpus) + 1.0) / (df + 1.0)) AS idf FROM vocab",
    ),
    (
        "doc_terms",
        "SELECT a.doc_id, a.term, a.tf, a.tf * w.idf AS x FROM all_terms a JOIN weights w USING (term)",
    ),
    ("v_size", "SELECT count(*) AS v FROM vocab"),
]


def start(fold: int, name: str = "state0") -> list[tuple[str, str]]:
    return [
        (
            name,
            f"""SELECT doc_id, sim, {row_hash()} AS x, label, label AS original_label,
                       CASE WHEN sim <> {fold} THEN 1 ELSE 0 END AS in_train,
                       CAST([] AS INT[]) AS neg
                FROM corpus""",
        )
    ]


def models(state: str, tag: str, outer: int = 3, inner: int = 3, shared: bool = False):
    """Class counts, thresholds, draws of one round."""
    key = f"'{SEED}|' || topic || '|' || i || '|' || {0 if shared else 'j'}"
    return [
        (
            f"counts{tag}",
            f"""SELECT t.topic,
                       count(s.doc_id) FILTER (s.label = t.topic) AS label,
                       count(s.doc_id) AS train_all
                FROM topics t LEFT JOIN {state} s
                  ON s.in_train = 1 OR list_contains(s.neg, t.topic)
                GROUP BY t.topic""",
        ),
        (
            f"plan{tag}",
            f"""SELECT topic, label, train_all - label AS non, train_all,
                       CASE WHEN train_all - label > 0 AND label / (train_all - label) < 0.1
                            THEN greatest(label * 10, train_all // 10) / (train_all - label)
                       END AS fraction
                FROM counts{tag}""",
        ),
        (
            f"models{tag}",
            f"""SELECT topic, i, j, fraction,
                       {hashed(key, 8)} % {P - 1} + 1 AS a, {hashed(key, 8, 9)} % {P} AS b
                FROM plan{tag}, range(1, {outer + 1}) AS r(i), range(1, {inner + 1}) AS q(j)""",
        ),
        (
            f"members{tag}",
            f"""SELECT s.doc_id, m.topic, m.i, m.j, (s.label = m.topic)::INT AS y,
                       m.fraction IS NOT NULL AS drawn
                FROM {state} s JOIN models{tag} m
                  ON s.in_train = 1 OR list_contains(s.neg, m.topic)
                WHERE s.label = m.topic OR m.fraction IS NULL
                   OR (s.x * m.a + m.b) % {P} < m.fraction * {P}""",
        ),
    ]


def nb_votes(state: str, tag: str, n_votes: int = 9) -> list[tuple[str, str]]:
    """One-vs-rest naive Bayes votes of the test rows, topics without positives voting 0."""
    return [
        (
            f"sizes{tag}",
            f"""SELECT topic, i, j, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0
                FROM members{tag} GROUP BY topic, i, j
                HAVING count(*) FILTER (y = 1) > 0 AND count(*) FILTER (y = 0) > 0""",
        ),
        (
            f"sums{tag}",
            f"""SELECT m.topic, m.i, m.j, d.term,
                       sum(d.tf) FILTER (m.y = 1) AS s1, sum(d.tf) FILTER (m.y = 0) AS s0
                FROM members{tag} m JOIN sizes{tag} z USING (topic, i, j)
                JOIN doc_terms d USING (doc_id) GROUP BY m.topic, m.i, m.j, d.term""",
        ),
        (
            f"totals{tag}",
            f"""SELECT z.topic, z.i, z.j, z.n1, z.n0,
                       coalesce(sum(s.s1 * w.idf), 0) AS t1, coalesce(sum(s.s0 * w.idf), 0) AS t0
                FROM sizes{tag} z LEFT JOIN sums{tag} s USING (topic, i, j)
                LEFT JOIN weights w USING (term) GROUP BY z.topic, z.i, z.j, z.n1, z.n0""",
        ),
        (
            f"coefficients{tag}",
            f"""SELECT t.topic, t.i, t.j, w.term,
                       ln(coalesce(s.s1, 0) * w.idf + {SMOOTHING})
                       - ln(t.t1 + {SMOOTHING} * (SELECT v FROM v_size))
                       - ln(coalesce(s.s0, 0) * w.idf + {SMOOTHING})
                       + ln(t.t0 + {SMOOTHING} * (SELECT v FROM v_size)) AS w
                FROM totals{tag} t CROSS JOIN weights w
                LEFT JOIN sums{tag} s
                  ON s.topic = t.topic AND s.i = t.i AND s.j = t.j AND s.term = w.term""",
        ),
        (
            f"margins{tag}",
            f"""SELECT s.doc_id, c.topic, c.i, c.j, sum(d.x * c.w) AS margin
                FROM {state} s JOIN doc_terms d USING (doc_id) JOIN coefficients{tag} c USING (term)
                WHERE s.in_train = 0 GROUP BY s.doc_id, c.topic, c.i, c.j""",
        ),
        (
            f"votes{tag}",
            f"""SELECT s.doc_id, s.neg, m.topic, m.i, m.j,
                       CASE WHEN z.topic IS NULL THEN CASE WHEN m.label > 0 THEN 1 ELSE 0 END
                            WHEN coalesce(g.margin, 0) + ln(z.n1 + {SMOOTHING})
                                 - ln(z.n0 + {SMOOTHING}) > 0 THEN 1 ELSE 0 END AS vote
                FROM {state} s
                CROSS JOIN (SELECT m.*, p.label FROM models{tag} m JOIN plan{tag} p USING (topic)) m
                LEFT JOIN totals{tag} z ON z.topic = m.topic AND z.i = m.i AND z.j = m.j
                LEFT JOIN margins{tag} g ON g.doc_id = s.doc_id AND g.topic = m.topic
                                        AND g.i = m.i AND g.j = m.j
                WHERE s.in_train = 0""",
        ),
        (
            f"tally{tag}",
            f"""SELECT doc_id, topic, CAST(sum(vote) AS BIGINT) AS tally FROM votes{tag}
                GROUP BY doc_id, topic""",
        ),
        (
            f"coded{tag}",
            f"""SELECT s.*, f.n_full, CASE WHEN f.n_full = 1 THEN f.topic END AS verdict
                FROM {state} s JOIN (
                    SELECT doc_id, count(*) FILTER (tally = {n_votes}) AS n_full,
                           max(topic) FILTER (tally = {n_votes}) AS topic
                    FROM tally{tag} GROUP BY doc_id) f USING (doc_id)""",
        ),
        (
            f"decided{tag}",
            f"""SELECT * REPLACE (CASE WHEN len(neg) = 0 THEN n_full ELSE 0 END AS n_full,
                                  CASE WHEN len(neg) = 0 THEN verdict END AS verdict)
                FROM coded{tag}""",
        ),
    ]


def check(tag: str, round_number: int, gate: float | None) -> list[tuple[str, str]]:
    """Validation sample and counters of a round."""
    key = quoted(f"{SEED}|validate|{round_number}")
    z_delta = SAMPLE_Z * SAMPLE_Z * 0.5 * 0.5 / (SAMPLE_DELTA * SAMPLE_DELTA)
    passes = f"coalesce(num_correct / nullif(num_sample, 0) >= {gate}, false)" if gate else "false"
    return [
        (
            f"classified{tag}",
            f"""SELECT *, (x * ({hashed(key, 8)} % {P - 1} + 1) + {hashed(key, 8, 9)} % {P}) % {P}
                          AS draw
                FROM decided{tag} WHERE verdict IS NOT NULL""",
        ),
        (
            f"sizing{tag}",
            f"""SELECT verdict, count(*) AS num_classified,
                       CASE WHEN count(*) <= {SAMPLE_MINIMUM} THEN count(*)
                            ELSE greatest({SAMPLE_MINIMUM}, CAST(ceil({z_delta!r}::DOUBLE
                                 / (1 + 1.0::DOUBLE / count(*) * ({z_delta!r}::DOUBLE - 1))) AS BIGINT))
                       END AS sample_size
                FROM classified{tag} GROUP BY verdict""",
        ),
        (
            f"ranked{tag}",
            f"""SELECT c.*, s.num_classified,
                       row_number() OVER (PARTITION BY verdict ORDER BY draw, doc_id) <= s.sample_size
                       AS checked
                FROM classified{tag} c JOIN sizing{tag} s USING (verdict)""",
        ),
        (
            f"sampled{tag}",
            f"""SELECT verdict, count(*) AS num_sample,
                       count(*) FILTER (label = verdict) AS num_correct
                FROM ranked{tag} WHERE checked GROUP BY verdict""",
        ),
        (
            f"numbers{tag}",
            f"""SELECT *, num_classified - num_sample AS num_non_sample,
                       num_sample - num_correct AS num_incorrect,
                       num_correct / nullif(num_sample, 0) AS precision_in_sample,
                       CASE WHEN {passes} THEN num_classified - (num_sample - num_correct)
                            ELSE num_correct END AS num_added_to_training,
                       {passes} AS passes
                FROM (SELECT t.topic, coalesce(s.num_classified, 0) AS num_classified,
                             coalesce(c.num_sample, 0) AS num_sample,
                             coalesce(c.num_correct, 0) AS num_correct
                      FROM topics t LEFT JOIN sizing{tag} s ON s.verdict = t.topic
                      LEFT JOIN sampled{tag} c ON c.verdict = t.topic)""",
        ),
    ]


def routed(tag: str, keep_negatives: bool) -> list[tuple[str, str]]:
    keep = "checked AND label <> verdict" if keep_negatives else "false"
    return [
        (
            f"accepted{tag}",
            f"""SELECT r.*, CASE WHEN checked THEN label = verdict ELSE n.passes END AS accept
                FROM ranked{tag} r JOIN numbers{tag} n ON n.topic = r.verdict""",
        ),
        (
            f"routed{tag}",
            f"""SELECT doc_id, sim, x, CASE WHEN accept THEN verdict ELSE label END AS label,
                       original_label, accept::INT AS in_train,
                       CASE WHEN {keep} THEN list_append(neg, verdict) ELSE neg END AS neg
                FROM accepted{tag}""",
        ),
    ]


def round_steps(variant: str, number: int, fold_tag: str = "", before: str | None = None, side: int = 3):
    """All expressions of one round, ending in the next state."""
    tag = f"{fold_tag}_{number}"
    state = before or f"state{fold_tag}{number - 1}"
    after = f"state{fold_tag}{number}"
    columns = "doc_id, sim, x, label, original_label, in_train, neg"
    steps = models(state, tag, side, side) + nb_votes(state, tag, side * side)
    trained = f"SELECT {columns} FROM {state} WHERE in_train = 1"
    if variant == "v0":
        steps += [
            (
                f"numbers{tag}",
                f"""SELECT verdict AS topic, count(*) AS num_classified, 0 AS num_sample,
                           count(*) AS num_added_to_training
                    FROM decided{tag} WHERE verdict IS NOT NULL GROUP BY verdict""",
            ),
            (
                after,
                f"""{trained} UNION ALL
                    SELECT doc_id, sim, x, coalesce(verdict, label), original_label,
                           (verdict IS NOT NULL)::INT, neg FROM decided{tag}""",
            ),
        ]
        return steps
    gate = GATES[variant][number - 1]
    steps += check(tag, number, gate) + routed(tag, variant != "v1")
    learned = "(n_full > 1)::INT" if variant == "v4" else "0"
    steps.append(
        (
            after,
            f"""{trained} UNION ALL SELECT {columns} FROM routed{tag} UNION ALL
                SELECT doc_id, sim, x, label, original_label, {learned}, neg
                FROM decided{tag} WHERE verdict IS NULL""",
        )
    )
    return steps


def sql(steps: list[tuple[str, str]], final: str) -> str:
    """The final statement with the expressions it needs, directly or through others."""
    chain = dict(steps)
    needed: set[str] = set()
    todo = [final]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & chain.keys() - needed:
            needed.add(name)
            todo.append(chain[name])
    parts = [f"{name} AS ({body})" for name, body in chain.items() if name in needed]
    return (f"WITH {', '.join(parts)} " if parts else "") + final


def named(source: str, key: str = "topic") -> str:
    """Category of a topic as a scalar."""
    return f"(SELECT category FROM names n WHERE n.topic = {source}.{key})"


FIRST = BASE + start(FOLD) + models("state0", "_1", 7, 7) + nb_votes("state0", "_1", 49)
GRID_STEPS = BASE + start(FOLD) + models("state0", "_1", 10, 10) + nb_votes("state0", "_1", 100)

RECALLS = "tp / nullif(tp + fp, 0)", "tp / n_items"


def multiclass(fold: int) -> list[tuple[str, str]]:
    """Multinomial naive Bayes verdicts of one fold."""
    t = f"_m{fold}"
    return [
        (
            f"class{t}",
            f"""SELECT label, count(*) AS n FROM corpus WHERE sim <> {fold} GROUP BY label""",
        ),
        (
            f"csum{t}",
            f"""SELECT c.label, d.term, sum(d.x) AS s FROM corpus c JOIN doc_terms d USING (doc_id)
                WHERE c.sim <> {fold} GROUP BY c.label, d.term""",
        ),
        (
            f"ctot{t}",
            f"""SELECT k.label, k.n, coalesce(sum(s.s), 0) AS total
                FROM class{t} k LEFT JOIN csum{t} s USING (label) GROUP BY k.label, k.n""",
        ),
        (
            f"prior{t}",
            f"""SELECT label, ln(n + {SMOOTHING})
                       - ln((SELECT sum(n) + {SMOOTHING} * count(*) FROM class{t})) AS pi,
                       ln(total + {SMOOTHING} * (SELECT v FROM v_size)) AS denominator
                FROM ctot{t}""",
        ),
        (
            f"theta{t}",
            f"""SELECT p.label, w.term, ln(coalesce(s.s, 0) + {SMOOTHING}) - p.denominator AS theta
                FROM prior{t} p CROSS JOIN weights w
                LEFT JOIN csum{t} s ON s.label = p.label AND s.term = w.term""",
        ),
        (
            f"score{t}",
            f"""SELECT c.doc_id, h.label, sum(d.x * h.theta) AS score
                FROM corpus c JOIN doc_terms d USING (doc_id) JOIN theta{t} h USING (term)
                WHERE c.sim = {fold} GROUP BY c.doc_id, h.label""",
        ),
        (
            f"best{t}",
            f"""SELECT c.doc_id, c.sim, c.label,
                       arg_max(p.label, p.pi + coalesce(s.score, 0)) AS verdict
                FROM corpus c CROSS JOIN prior{t} p
                LEFT JOIN score{t} s ON s.doc_id = c.doc_id AND s.label = p.label
                WHERE c.sim = {fold} GROUP BY c.doc_id, c.sim, c.label""",
        ),
    ]


def union_all(names: list[str], columns: str = "*") -> str:
    return " UNION ALL ".join(f"SELECT {columns} FROM {n}" for n in names)


def pr_steps(source: str, tag: str) -> list[tuple[str, str]]:
    """Precision and recall by fold and topic of rows (sim, label, verdict)."""
    return [
        (
            f"pr{tag}",
            f"""SELECT sim, topic, tp, fp, n_items, tp / nullif(tp + fp, 0) AS "precision",
                       tp / n_items AS recall
                FROM (SELECT i.sim, i.topic, i.n_items,
                             (SELECT count(*) FROM {source} r WHERE r.sim = i.sim
                              AND r.verdict = i.topic AND r.label = i.topic) AS tp,
                             (SELECT count(*) FROM {source} r WHERE r.sim = i.sim
                              AND r.verdict = i.topic AND r.label <> i.topic) AS fp
                      FROM (SELECT sim, label AS topic, count(*) AS n_items FROM {source}
                            GROUP BY sim, label) i)""",
        ),
        (
            f"mean{tag}",
            f"""SELECT topic, CASE WHEN count("precision") = 3 THEN sum("precision") / 3 END AS "precision",
                       CASE WHEN count(recall) = 3 THEN sum(recall) / 3 END AS recall
                FROM pr{tag} GROUP BY topic""",
        ),
    ]


NB_ALL = (
    BASE
    + multiclass(1)
    + multiclass(2)
    + multiclass(3)
    + [("nb_rows", union_all(["best_m1", "best_m2", "best_m3"]))]
    + pr_steps("nb_rows", "_nb")
)

VOTE_ALL: list[tuple[str, str]] = []
for _f in (1, 2, 3):
    VOTE_ALL += start(_f, f"start_f{_f}")
    VOTE_ALL += models(f"start_f{_f}", f"_f{_f}", 7, 7)
    VOTE_ALL += nb_votes(f"start_f{_f}", f"_f{_f}", 49)
VOTE_ALL += [
    (
        "vote_rows",
        union_all(["decided_f1", "decided_f2", "decided_f3"], "doc_id, sim, label, verdict"),
    )
]
VOTE_ALL += pr_steps("vote_rows", "_vote")
BOTH = (
    NB_ALL
    + VOTE_ALL
    + [
        (
            "both_models",
            """SELECT n.topic, n."precision" AS precision_nb, n.recall AS recall_nb,
                      v."precision" AS precision_vote, v.recall AS recall_vote
               FROM mean_nb n LEFT JOIN mean_vote v USING (topic)""",
        ),
        (
            "long_pr",
            """SELECT topic, 'nb' AS model, precision_nb AS "precision", recall_nb AS recall
               FROM both_models UNION ALL
               SELECT topic, 'vote', precision_vote, recall_vote FROM both_models""",
        ),
    ]
)


def workflow(variant: str, n_rounds: int, fold: int = FOLD, fold_tag: str = "", side: int = 3):
    steps = start(fold, f"state{fold_tag}0")
    for number in range(1, n_rounds + 1):
        steps += round_steps(variant, number, fold_tag, side=side)
    return steps


def all_folds(variant: str, n_rounds: int, tag: str):
    """Rounds of the three folds; the folds' last states are ``state{tag}{fold}r{n}``."""
    steps: list[tuple[str, str]] = []
    for fold in (1, 2, 3):
        steps += workflow(variant, n_rounds, fold, f"{tag}{fold}r")
    return steps


def clean_sql(text: str) -> str:
    cut = re.sub("'", "''", DELETED_CHARACTERS)
    digits = rf"regexp_replace({text}, '[0-9]+', '', 'g')"
    punct = rf"regexp_replace({digits}, '[[:punct:]]+', '', 'g')"
    squeezed = rf"regexp_replace({punct}, '{SPACE}', ' ', 'g')"
    kept = words_removed(f"lower({squeezed})")
    return rf"regexp_replace(translate({kept}, '{cut}', ''), '{SPACE}', ' ', 'g')"


def words_removed(text: str) -> str:
    """Whole runs that are listed go, and the listed parts of a run with apostrophes."""
    part = f"CASE WHEN list_contains({STOP_LIST}, p) THEN '' ELSE p END"
    return (
        rf"array_to_string(list_transform(list_filter(regexp_extract_all({text}, '{WORD_OR_GAP}'), "
        rf"lambda w: NOT list_contains({STOP_LIST}, w)), lambda w: array_to_string("
        rf"list_transform(string_split(w, ''''), lambda p: {part}), '''')), '')"
    )


def tag_sql(name: str) -> str:
    return f"nullif(regexp_extract(html, '<{name}>([^<]*)</{name}>', 1), '')"


LOGS = [
    (
        "logs",
        """SELECT CASE event_type WHEN 'error' THEN 'ERROR : HTTP error 429 ;'
                       WHEN 'signup' THEN 'ERROR : replacement has length zero ;'
                       WHEN 'click' THEN 'ERROR : undefined columns selected ;'
                       WHEN 'purchase' THEN 'ERROR : subscript out of bounds ;'
                       ELSE 'URL ' || user_id || ' added;' END AS api_logs, event_type FROM events""",
    )
]
ERROR_COUNTS = sql(
    LOGS,
    """SELECT api_logs, count(*) AS n_errortype FROM logs
       WHERE api_logs NOT LIKE '%ERROR : subscript out of bounds%' AND api_logs LIKE '%ERROR :%'
       GROUP BY api_logs""",
)
NEGATIVES = "array_to_string(list_sort(neg), ',') AS negatives"
SAMPLE_LOG = """SELECT m.topic, CAST(m.i AS INT) AS i, CAST(m.j AS INT) AS j, p.label,
                       p.non AS non_label_all,
                       count(*) FILTER (b.y = 0) AS non_label_sample,
                       p.label + count(*) FILTER (b.y = 0) AS train_all
                FROM models_1 m JOIN plan_1 p USING (topic)
                LEFT JOIN members_1 b ON b.topic = m.topic AND b.i = m.i AND b.j = m.j
                GROUP BY m.topic, m.i, m.j, p.label, p.non"""
DRAWN = """SELECT doc_id, topic, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM members_1
           WHERE drawn AND y = 0"""


def _route_query(gate: float | None, keep: bool) -> str:
    return sql(
        FIRST + check("_1", 1, gate) + routed("_1", keep),
        f"SELECT doc_id, label, original_label, in_train, {NEGATIVES} FROM routed_1",
    )


def oracle_sql() -> dict[str, str]:
    first_check = FIRST + check("_1", 1, 0.75)
    out = {
        "topic_recode_counts": sql(BASE, "SELECT label, count(*) AS n FROM corpus GROUP BY label"),
        "topic_recode_21_counts": sql(
            BASE,
            """SELECT label, count(*) AS n FROM (
                 SELECT CASE WHEN majortopic = 20 THEN 100 WHEN majortopic > 21 THEN 100
                        ELSE majortopic END AS label FROM raw_corpus) GROUP BY label""",
        ),
        "sim_topic_counts": sql(
            BASE,
            f"""SELECT topic, sim_1, sim_2, sim_3, {named('c')} AS category FROM (
                  SELECT label AS topic, count(*) FILTER (sim = 1) AS sim_1,
                         count(*) FILTER (sim = 2) AS sim_2, count(*) FILTER (sim = 3) AS sim_3
                  FROM corpus GROUP BY label) c""",
        ),
        "start_corpus_build": sql(
            BASE,
            f"""SELECT r.doc_id, r.majortopic, '20240101' AS date,
                       title || ' ' || r.text || ' ' || coalesce(headline, '') AS text,
                       CAST({row_hash('r.doc_id')} % 3 + 1 AS INT) AS sim
                FROM raw_corpus r
                JOIN (SELECT page_id, url, {tag_sql('title')} AS title, {tag_sql('h1')} AS headline
                      FROM pages) p ON p.page_id = r.doc_id
                JOIN labels l ON l.doc_id = r.doc_id
                WHERE l.quality = 1 AND coalesce(title, '') <> '' AND coalesce(url, '') <> ''""",
        ),
        "start_corpus_csv": sql(
            BASE,
            """SELECT doc_id, majortopic, '20240101' AS date, text, CAST(sim AS INT) AS sim
               FROM raw_corpus""",
        ),
        "fold_split": sql(
            BASE,
            """SELECT CAST(f.fold AS INT) AS fold, label, count(*) FILTER (sim <> fold) AS n_train,
                      count(*) FILTER (sim = fold) AS n_test
               FROM corpus, range(1, 4) AS f(fold) GROUP BY f.fold, label""",
        ),
        "random_split": f"""SELECT doc_id, CAST({row_hash()} % 3 + 1 AS INT) AS sim,
                                   CASE WHEN {row_hash()} < {0.8 * P!r} THEN 'train' ELSE 'test' END
                                   AS part FROM documents""",
        "text_clean": f"SELECT doc_id, {clean_sql('text')} AS text FROM documents",
        "stopword_filter": f"SELECT doc_id, {words_removed('lower(text)')} AS text FROM documents",
        "tokens_vocab": sql(BASE, "SELECT term, df, tc FROM vocab"),
        "tfidf_terms_by_document": sql(
            BASE, "SELECT doc_id, term, CAST(tf AS INT) AS tf, round(x, 6) AS tfidf FROM doc_terms"
        ),
        "top_terms_by_topic": sql(
            BASE,
            f"""SELECT topic, term, score, "rank", {named('r')} AS category FROM (
                  SELECT topic, term, score,
                         row_number() OVER (PARTITION BY topic ORDER BY score DESC, term) AS "rank"
                  FROM (SELECT c.label AS topic, d.term, round(sum(d.tf) * any_value(w.idf), 6) AS score
                        FROM corpus c JOIN doc_terms d USING (doc_id) JOIN weights w USING (term)
                        GROUP BY c.label, d.term)) r WHERE "rank" <= 10""",
        ),
        "trimmed_dfm": rf"""WITH words AS (
              SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(regexp_replace(
                       regexp_replace(text, '[[:punct:]]+', '', 'g'), '[0-9]+', '', 'g')), '{SPACE}'),
                     lambda w: w <> '' AND NOT list_contains({STOP_LIST}, w))) AS feature
              FROM documents),
            counts AS (SELECT doc_id, feature, CAST(count(*) AS INT) AS tf FROM words GROUP BY ALL),
            kept AS (SELECT feature FROM counts GROUP BY feature HAVING count(*) >= 50
                     AND count(*) <= 0.8 * (SELECT count(*) FROM documents))
            SELECT doc_id, feature, tf FROM counts JOIN kept USING (feature)""",
        "csv_without_wide_columns": sql(
            BASE, "SELECT doc_id, majortopic, CAST(sim AS INT) AS sim FROM raw_corpus"
        ),
        "class_name_codes": sql(
            BASE, "SELECT 'Class: ' || label AS class, label AS topic, count(*) AS n FROM corpus GROUP BY label"
        ),
        "error_kinds": sql(
            LOGS,
            """SELECT api_logs, CAST(event_type = 'purchase' AS INT) AS overrun,
                      CAST(event_type IN ('error', 'signup', 'click', 'purchase') AS INT) AS error,
                      CAST(event_type = 'error' AS INT) AS http_error,
                      CAST(event_type = 'signup' AS INT) AS length_zero,
                      CAST(event_type = 'click' AS INT) AS undefined_columns, count(*) AS n
               FROM logs GROUP BY api_logs, event_type""",
        ),
        "ovr_class_counts": sql(
            FIRST, "SELECT topic, label, non AS non_label_all, train_all FROM plan_1"
        ),
        "negative_sample_numbers": sql(FIRST, SAMPLE_LOG),
        "negative_sample": sql(FIRST, DRAWN),
        "negative_sample_shared": sql(
            BASE + start(FOLD) + models("state0", "_1", 7, 7, shared=True), DRAWN
        ),
        "nb_multiclass": sql(NB_ALL, "SELECT doc_id, sim, label, verdict FROM best_m3"),
        "nb_index_map": sql(
            BASE,
            """SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS index, label
               FROM (SELECT DISTINCT label FROM corpus)""",
        ),
        "nb_votes": sql(
            FIRST,
            """SELECT doc_id, topic, CAST(i AS INT) AS i, CAST(j AS INT) AS j, vote FROM votes_1""",
        ),
        "nb_votes_partitioned": sql(
            FIRST,
            """SELECT doc_id, vote, topic, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM votes_1""",
        ),
        "votes_wide": sql(
            FIRST,
            "SELECT doc_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, "
            + ", ".join(
                f"CAST(max(vote * topic) FILTER (topic = {t}) AS INT) AS prediction_{t}" for t in TOPICS
            )
            + " FROM votes_1 GROUP BY doc_id, i, j",
        ),
        "vote_tally": sql(FIRST, "SELECT doc_id, topic, tally FROM tally_1"),
        "unanimous_verdict": sql(
            FIRST, "SELECT doc_id, verdict FROM coded_1 WHERE verdict IS NOT NULL"
        ),
        "tied_docs": sql(FIRST, "SELECT doc_id, n_full FROM coded_1 WHERE n_full > 1"),
        "verdict_strictness_sweep": sql(
            GRID_STEPS
            + [
                (
                    "graded",
                    """SELECT doc_id, g, topic, sum(vote) = any_value(g.g * g.g) AS is_full
                       FROM votes_1, range(1, 11) AS g(g) WHERE i <= g AND j <= g
                       GROUP BY doc_id, g, topic""",
                ),
                (
                    "strict",
                    """SELECT doc_id, g, max(topic) AS verdict FROM graded WHERE is_full
                       GROUP BY doc_id, g HAVING count(*) = 1""",
                ),
                (
                    "hits",
                    """SELECT CAST(g AS INT) AS g, count(*) AS n_verdicts,
                              count(*) FILTER (s.label = v.verdict) AS tp,
                              (SELECT count(*) FROM state0 WHERE in_train = 0) AS n
                       FROM strict v JOIN state0 s USING (doc_id) GROUP BY g""",
                ),
            ],
            """SELECT g, n_verdicts, tp, round(tp / n_verdicts, 6) AS "precision",
                      round(tp / n, 6) AS recall,
                      round(2 * (tp / n_verdicts) * (tp / n)
                            / nullif(tp / n_verdicts + tp / n, 0), 6) AS f1
               FROM hits""",
        ),
        "ensemble_verdict": sql(
            FIRST, "SELECT doc_id, label, CAST(n_full AS INT) AS n_full, coalesce(verdict, 0) AS verdict FROM decided_1"
        ),
        "self_training_labels": sql(
            FIRST,
            """SELECT c.doc_id, c.label AS old_label, coalesce(d.verdict, c.label) AS new_label
               FROM corpus c LEFT JOIN decided_1 d USING (doc_id)""",
        ),
        "train_test_split_round": sql(
            BASE + workflow("v0", 1, side=7),
            """SELECT label, count(*) FILTER (in_train = 1) AS n_train,
                      count(*) FILTER (in_train = 0) AS n_test FROM state1 GROUP BY label""",
        ),
        "classified_remaining_split": sql(
            FIRST,
            """SELECT doc_id, CASE WHEN verdict IS NULL THEN 'remaining' ELSE 'classified' END AS part
               FROM decided_1""",
        ),
        "validation_sample_size": sql(
            first_check, "SELECT verdict, num_classified, sample_size FROM sizing_1"
        ),
        "validation_sample": sql(
            first_check,
            """SELECT doc_id, verdict, (label = verdict)::INT AS correct FROM ranked_1
               WHERE checked""",
        ),
        "validation_numbers": sql(
            first_check,
            """SELECT topic, num_classified, num_sample, num_non_sample, num_correct, num_incorrect,
                      round(precision_in_sample, 6) AS precision_in_sample, num_added_to_training,
                      passes::INT AS passes FROM numbers_1""",
        ),
        "gate_route_basic": _route_query(None, False),
        "gate_route_gated": _route_query(0.75, False),
        "gate_route_stepwise": _route_query(0.85, True),
        "active_learning_route": sql(
            FIRST, "SELECT doc_id, label, 1 AS in_train FROM decided_1 WHERE n_full > 1"
        ),
        "known_negative_training": sql(
            BASE + workflow("v2", 1, side=7) + models("state1", "_2"),
            "SELECT topic, label, non AS non_label_all, train_all FROM plan_2",
        ),
        "verdict_flags": sql(
            FIRST,
            """SELECT doc_id, CAST(sim AS INT) AS sim, label, coalesce(verdict, 0) AS verdict,
                      coalesce(label = verdict, false)::INT AS correct,
                      CASE WHEN verdict IS NULL THEN 'not classified' ELSE 'classified' END AS classified,
                      coalesce(label <> verdict, false)::INT AS fp,
                      coalesce(label = verdict, false)::INT AS tp FROM decided_1""",
        ),
        "pr_by_topic": sql(
            BASE + VOTE_ALL,
            """SELECT CAST(sim AS INT) AS sim, topic, tp, fp, n_items, round("precision", 6) AS "precision",
                      round(recall, 6) AS recall FROM pr_vote""",
        ),
        "pr_total": sql(
            BASE + VOTE_ALL,
            """SELECT tp, fp, n_items, round(tp / (tp + fp), 6) AS "precision",
                      round(tp / n_items, 6) AS recall, round(2 * tp / (tp + fp + n_items), 6) AS f1
               FROM (SELECT count(*) FILTER (label = verdict) AS tp,
                            count(*) FILTER (label <> verdict) AS fp, count(*) AS n_items
                     FROM vote_rows)""",
        ),
        "fold_mean_pr": sql(
            NB_ALL,
            """SELECT topic, round("precision", 6) AS "precision", round(recall, 6) AS recall
               FROM mean_nb""",
        ),
        "confusion_matrix": sql(
            NB_ALL,
            "SELECT verdict, "
            + ", ".join(f"count(*) FILTER (label = {t}) AS actual_{t}" for t in TOPICS)
            + " FROM nb_rows GROUP BY verdict",
        ),
        "class_report": sql(
            NB_ALL,
            """SELECT topic, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
                      CAST(n_items AS BIGINT) AS n_items,
                      round(tp / nullif(tp + fp, 0), 6) AS "precision",
                      round(tp / n_items, 6) AS recall,
                      CASE WHEN tp > 0 THEN round(2 * tp / (tp + fp + n_items), 6) END AS f1
               FROM (SELECT topic, sum(tp) AS tp, sum(fp) AS fp, sum(n_items) AS n_items
                     FROM pr_nb GROUP BY topic)""",
        ),
        "model_wins": sql(
            BOTH,
            """SELECT count(*) FILTER (precision_vote > precision_nb) AS precision_wins,
                      count(*) FILTER (recall_vote > recall_nb) AS recall_wins,
                      count(*) FILTER (precision_vote >= 0.85) AS precision_085,
                      count(*) FILTER (precision_vote >= 0.8) AS precision_080 FROM both_models""",
        ),
        "pr_comparison": sql(
            BOTH,
            f"""SELECT topic, {named('b')} AS category, round(precision_nb, 6) AS precision_nb,
                       round(recall_nb, 6) AS recall_nb, round(precision_vote, 6) AS precision_vote,
                       round(recall_vote, 6) AS recall_vote FROM both_models b""",
        ),
        "pr_comparison_means": sql(
            BOTH,
            """SELECT topic, round(precision_nb, 2) AS precision_nb, round(recall_nb, 2) AS recall_nb,
                      round(precision_vote, 2) AS precision_vote, round(recall_vote, 2) AS recall_vote
               FROM (SELECT * FROM both_models UNION ALL
                     SELECT 0, avg(precision_nb), avg(recall_nb), avg(precision_vote),
                            avg(recall_vote) FROM both_models)""",
        ),
        "pr_highlights": sql(
            BOTH,
            f"""SELECT metric, topic, model, score, CAST(row_number() OVER (
                         PARTITION BY metric ORDER BY score DESC, topic, model) AS INT) AS "rank",
                       {named('h')} AS category
                FROM (SELECT 'precision' AS metric, topic, model, round("precision", 6) AS score
                      FROM long_pr WHERE "precision" >= 0.8 UNION ALL
                      SELECT 'recall', topic, model, round(recall, 6) FROM long_pr
                      WHERE recall >= 0.5) h""",
        ),
        "metrics_long": sql(
            BOTH,
            """SELECT topic, model, round("precision", 6) AS "precision", round(recall, 6) AS recall
               FROM long_pr""",
        ),
        "metrics_wide": sql(
            NB_ALL,
            "SELECT topic, "
            + ", ".join(
                f'round(max("{m}") FILTER (sim = {f}), 6) AS {m}_fold{f}'
                for m in ("precision", "recall")
                for f in (1, 2, 3)
            )
            + " FROM pr_nb GROUP BY topic",
        ),
        "null_audit": f"""WITH audited AS (
              SELECT d.doc_id, d.lang, {tag_sql('title')} AS title, {tag_sql('h2')} AS subtitle
              FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id)
            SELECT 'doc_id' AS "column", count(*) - count(doc_id) AS n_null FROM audited UNION ALL
            SELECT 'lang', count(*) - count(lang) FROM audited UNION ALL
            SELECT 'title', count(*) - count(title) FROM audited UNION ALL
            SELECT 'subtitle', count(*) - count(subtitle) FROM audited""",
        "error_counts": ERROR_COUNTS,
        "log_files": ERROR_COUNTS,
        "repair_merge": """SELECT d.doc_id, d.lang,
              CASE WHEN p.url IS NOT NULL THEN p.url
                   WHEN l.quality = 1 THEN 'fixed/' || d.doc_id END AS url_api,
              CASE WHEN p.url IS NULL AND l.doc_id IS NOT NULL THEN 'second' END AS attempt
            FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id
            LEFT JOIN labels l ON l.doc_id = d.doc_id""",
        "row_range": """SELECT event_id, user_id, event_type, row_nr FROM (
              SELECT *, row_number() OVER (ORDER BY event_id) AS row_nr FROM events)
            WHERE row_nr BETWEEN 301 AND 700""",
        "query_titles": f"""SELECT page_id, array_to_string(list_filter(string_split(lower(
                     regexp_replace(title, '\\p{{P}}+', '', 'g')), ' '),
                     lambda w: NOT list_contains({STOP_LIST}, w)), '+') AS title_q,
                   array_to_string(string_split(lower(title), ' ')[1:3], '+') AS short_q
            FROM (SELECT page_id, {tag_sql('title')} AS title FROM pages)""",
        "date_keys": """SELECT event_id, strftime(ts, '%Y%m%d') AS date_q,
              CAST(year(ts) AS INT) AS article_year, CAST(month(ts) AS INT) AS month_year,
              year(ts) || '_' || month(ts) AS year_month FROM events""",
        "json_flatten": f"""SELECT page_id, CASE WHEN even THEN url END AS url_api,
              CASE WHEN even THEN title END AS abstract, CAST(NULL AS VARCHAR) AS lead_paragraph,
              CAST(NULL AS VARCHAR) AS print_section, CAST(NULL AS VARCHAR) AS print_page,
              CASE WHEN even THEN h1 END AS headline_main,
              CASE WHEN even THEN h2 END AS headline_print,
              CASE WHEN even THEN 'k' || page_id END AS keywords,
              CAST(NULL AS VARCHAR) AS pub_date, CAST(NULL AS VARCHAR) AS document_type,
              CAST(NULL AS VARCHAR) AS news_desk, CAST(NULL AS VARCHAR) AS section_name,
              CASE WHEN even THEN 'By ' || page_id END AS byline,
              CASE WHEN even THEN CAST(length(html) AS VARCHAR) END AS word_count, page_id AS api_hits
            FROM (SELECT *, page_id % 2 = 0 AS even, {tag_sql('title')} AS title,
                         {tag_sql('h1')} AS h1, {tag_sql('h2')} AS h2 FROM pages)""",
        "event_props": """SELECT event_id, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k
            FROM events""",
    }
    for variant in ("v0", "v1", "v2", "v3", "v4"):
        out[f"workflow_{variant}"] = sql(
            BASE + workflow(variant, 5),
            f"SELECT doc_id, label, original_label, in_train, {NEGATIVES} FROM state5",
        )

    for v in list(VARIANT_NAMES)[1:]:
        summaries = BASE + all_folds(v, 5, v)
        summaries += [
            (
                f"final_rows_{v}",
                " UNION ALL ".join(
                    f"""SELECT sim, original_label AS label, CASE WHEN in_train = 1 THEN label END AS verdict
                        FROM state{v}{f}r5 WHERE sim = {f}"""
                    for f in (1, 2, 3)
                ),
            ),
            *pr_steps(f"final_rows_{v}", f"_final_{v}"),
            (
                f"counters_{v}",
                union_all([f"numbers{v}{f}r_{n}" for f in (1, 2, 3) for n in range(1, 6)]),
            ),
            (
                f"counter_sums_{v}",
                "SELECT topic, "
                + ", ".join(
                    f"CAST(sum({c}) AS BIGINT) AS {c}"
                    for c in (
                        "num_classified",
                        "num_sample",
                        "num_non_sample",
                        "num_correct",
                        "num_incorrect",
                        "num_added_to_training",
                    )
                )
                + f" FROM counters_{v} GROUP BY topic",
            ),
            (
                f"summary_{v}",
                f"""SELECT topic, CAST(sum(tp) AS BIGINT) AS one, CAST(sum(fp) AS BIGINT) AS zero,
                          CAST(sum(tp + fp) AS BIGINT) AS total_result,
                          CAST(sum(n_items) AS BIGINT) AS n_items,
                          avg("precision") AS "precision", avg(recall) AS recall
                   FROM pr_final_{v} GROUP BY topic""",
            ),
            (f"joined_{v}", f"SELECT * FROM summary_{v} LEFT JOIN counter_sums_{v} USING (topic)"),
        ]
        sums = (
            "one",
            "zero",
            "total_result",
            "n_items",
            "num_classified",
            "num_sample",
            "num_non_sample",
            "num_correct",
            "num_incorrect",
            "num_added_to_training",
        )
        listed = ", ".join(sums)
        totals = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in sums)
        out["variant_summary" if v == "v3" else f"variant_summary_{v}"] = sql(
            summaries,
            f"""SELECT topic, {listed}, round("precision", 6) AS "precision", round(recall, 6) AS recall
                FROM joined_{v} UNION ALL
                SELECT 0, {totals}, round(sum(one) / sum(total_result), 6),
                       round(sum(one) / sum(n_items), 6) FROM joined_{v}""",
        )
    def progress(variants) -> str:
        return " UNION ALL ".join(
            f"""SELECT '{v}' AS variant, {n} AS round, num_classified, num_added_to_training,
                               num_sample FROM numbers{v}{f}r_{n}"""
            for v in variants
            for f in (1, 2, 3)
            for n in range(1, 6)
        )

    means = """SELECT variant, CAST(round AS INT) AS round,
                      round(sum(num_classified) / 3, 6) AS num_classified,
                      round(sum(num_added_to_training) / 3, 6) AS num_added_to_training,
                      round(sum(num_sample) / 3, 6) AS num_sample
               FROM progress GROUP BY variant, round"""
    # The steps of a variant are inside its own expression: all together are nested too deep. A round without any
    # verdict has a row too.
    study = list(BASE)
    for v in VARIANT_NAMES:
        study.append((f"progress_{v}", sql(all_folds(v, 5, v), progress([v]))))
    none = " UNION ALL ".join(f"SELECT '{v}', unnest([1, 2, 3, 4, 5]), 0, 0, 0" for v in VARIANT_NAMES)
    study.append(("progress", union_all([f"progress_{v}" for v in VARIANT_NAMES]) + " UNION ALL " + none))
    out["convergence"] = sql(study, means)

    study = list(BASE)
    for v in ("v2", "v3", "v4"):
        study += all_folds(v, 5, v)
    study.append(("progress", progress(("v2", "v3", "v4"))))
    out["convergence_gated"] = sql(study, means)
    return out
