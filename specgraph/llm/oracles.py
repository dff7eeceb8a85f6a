"""DuckDB SQL for the operators that SQL can express. It takes doc_id and item_id for keys."""

from __future__ import annotations

from specgraph.llm import collocation, lexical, supervision

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def lexical_search() -> str:
    """Every document's score for every item, and the best of them."""
    terms = f"unnest(regexp_extract_all({_LOW}, '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term"
    return f"""WITH o AS (SELECT doc_id, {terms} FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM o GROUP BY ALL), d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id), s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM d),
    m AS (SELECT doc_id, 75 + (25 * n * nn) // ll AS m FROM d, s), w AS (SELECT term, floor(1000 * ln((2.0 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term),
    q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, {terms} FROM benchmark) b GROUP BY ALL),
    score AS (SELECT item_id, doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM score WHERE score > 0) SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {lexical.TOP}"""


def collocations() -> str:
    """Counts of all phrases, scores of all cuts, and the best phrases that no longer one covers."""
    least, most = collocation.LEAST, collocation.MOST_WORDS
    return f"""WITH p AS (SELECT coalesce(lang, '{collocation.NO_LANGUAGE}') AS lang, unnest(string_split_regex({_LOW}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents), v AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM p), k AS (SELECT unnest(range(1, {most} + 1)) AS k),
    g AS (SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, k, words, unnest(range(1, len(words) - k + 2)) AS i FROM v, k WHERE len(words) >= k) x), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL), total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE f >= {least}), long AS (SELECT lang, f, array_to_string(words[i : i + n - 1], ' ') AS phrase FROM (SELECT lang, f, words, n, unnest(range(1, k - n + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS n FROM c WHERE k > 2) x) y),
    kept AS (SELECT c.* FROM c WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM long l WHERE l.lang = c.lang AND l.phrase = c.phrase AND l.f >= c.f)), cut AS (SELECT lang, phrase, f AS a, i, array_to_string(words[1 : i], ' ') AS head, array_to_string(words[i + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS i FROM kept) x),
    s AS (SELECT cut.lang, cut.phrase, a, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score, i FROM cut JOIN c l ON l.lang = cut.lang AND l.phrase = head JOIN c r ON r.lang = cut.lang AND r.phrase = tail JOIN total ON total.lang = cut.lang),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1), z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) SELECT lang, rank, phrase, a, l, r, n, score FROM z WHERE rank <= {collocation.TOP}"""


def quality_rules() -> str:
    """Statistics of each text, votes, rounds of expectation-maximisation as one step of SQL each, and posteriors."""
    rules, good, bad = supervision.RULES, supervision.GOOD, supervision.BAD
    window, weight = supervision.WINDOW, supervision.WEIGHT
    first = [(j, v, r.expected(supervision.ON_GOOD)[v], r.expected(supervision.ON_BAD)[v]) for j, r in enumerate(rules) for v in (supervision.NONE, good, bad)]

    def vote(rule: supervision.Rule) -> str:
        x = f"({rule.share})"
        fine = f"WHEN {x} BETWEEN {rule.good[0]} AND {rule.good[1]} THEN {good}" if rule.good else ""
        return f"CASE WHEN {x} < {rule.fair[0]} OR {x} > {rule.fair[1]} THEN {bad} {fine} ELSE 0 END"

    steps = [f"r0(j, v, g, b) AS (VALUES {', '.join(map(str, first))}), s0(good) AS (VALUES ({supervision.FIRST_GOOD_SHARE}))"]
    post = "SELECT {key}, 1 / (1 + exp(ln((1 - s.good) / s.good) + sum(CASE WHEN r.g > 0 AND r.b > 0 THEN ln(r.b / r.g) ELSE 0 END))) AS p FROM {votes} o JOIN r{k} r ON r.j = o.j AND r.v = o.v CROSS JOIN s{k} s GROUP BY {key}, s.good"
    for k in range(supervision.ROUNDS):
        steps.append(f"p{k} AS MATERIALIZED ({post.format(key='pat, n', votes='o', k=k)}), t{k} AS MATERIALIZED (SELECT sum(n * p) AS g, sum(n - n * p) AS b FROM p{k})")
        steps.append(f"""r{k + 1} AS MATERIALIZED (SELECT f.j, f.v, (coalesce(x.g, 0) + {weight} * f.g) / (t.g + {weight}) AS g, (coalesce(x.b, 0) + {weight} * f.b) / (t.b + {weight}) AS b FROM r0 f CROSS JOIN t{k} t LEFT JOIN (SELECT j, v, sum(p.n * p.p) AS g, sum(p.n - p.n * p.p) AS b FROM o JOIN p{k} p ON p.pat = o.pat GROUP BY j, v) x ON x.j = f.j AND x.v = f.v),
        s{k + 1} AS MATERIALIZED (SELECT (g + {supervision.FIRST_GOOD_SHARE}) / (g + b + 1) AS good FROM t{k})""")
    symbols = "[#*$%&|<>]"
    each = " UNION ALL ".join(f"SELECT doc_id, {j} AS j, v{j} AS v FROM voted" for j in range(len(rules)))
    every = " UNION ALL ".join(f"SELECT pat, n, {j} AS j, v{j} AS v FROM pattern" for j in range(len(rules)))
    names = ", ".join(f"v{j}" for j in range(len(rules)))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {_BLANK}) <> '') AS lines FROM documents),
    g AS (SELECT doc_id, i, array_to_string(words[i : i + {window - 1}], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - {window} + 2)) AS i FROM d WHERE len(words) >= {window}) x), again AS (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g),
    rep AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM again CROSS JOIN (SELECT unnest(range({window})) AS o) k WHERE times > 1 GROUP BY doc_id),
    st AS MATERIALIZED (SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '{symbols}'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_distinct(words)) AS n_distinct_words, len(lines) AS n_lines, len(list_filter(lines, lambda x: right(trim(x, {_BLANK}), 1) IN ('.', '!', '?'))) AS n_ended_lines, len(list_filter(lines, lambda x: regexp_matches(x, '({symbols}[^#*$%&|<>]*){{3}}'))) AS n_symbol_lines, len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper,
    length(text) - length(replace(text, '!', '')) AS n_exclamations FROM d LEFT JOIN rep USING (doc_id)),
    voted AS MATERIALIZED (SELECT *, n_words < {supervision.MIN_WORDS} OR 100 * n_repeat_words > {supervision.MAX_REPEATED_PERCENT} * n_words AS base_failed, {', '.join(f'{vote(r)} AS v{j}' for j, r in enumerate(rules))} FROM st),
    pattern AS MATERIALIZED (SELECT {names}, count(*) AS n, row_number() OVER () AS pat FROM voted WHERE NOT base_failed GROUP BY {names}), o AS MATERIALIZED ({every}), {', '.join(steps)}, final AS ({post.format(key='doc_id', votes=f'({each})', k=supervision.ROUNDS)})
    SELECT st.doc_id, st.n_words, st.word_chars, st.n_symbols, st.n_dup_lines, st.n_repeat_words, v.base_failed AS base_failed, NOT v.base_failed AND round(p, {supervision.DIGITS}) >= {supervision.KEEP_AT} AS kept, round(p, {supervision.DIGITS}) AS posterior
    FROM st JOIN voted v ON v.doc_id = st.doc_id JOIN final ON final.doc_id = st.doc_id"""
