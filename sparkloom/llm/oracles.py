"""DuckDB SQL for the queries of this subpackage that SQL can express."""

#: The pages of the given tables keep their article in one article element, which SQL can cut out and strip.
OP1_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '<[^>]*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""

#: Every pair of equal label by its cosine; a component is what links reach, step by step.
OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.x),
c AS (SELECT x AS vec_id, min(c) AS component_id FROM r GROUP BY x), k AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""


def _op9() -> str:
    """Robust covariance per group in plain SQL: the same starts, steps and cutoffs, written as joined CTEs."""
    dims, unit = (1, 2, 3, 4), 4096
    floor = {1: 0.05, 2: 0.02, 3: 0.04, 4: 0.04}
    pairs = [(i, j) for i in dims for j in range(1, i + 1)]
    out: list[tuple[str, str]] = []

    def cte(name: str, sql: str) -> str:
        out.append((name, sql))
        return name

    def solve(src: str, keys: str) -> str:
        """LDL factors of k_ij, one column after the other."""
        for j in dims:
            v = f"k{j}{j}" + "".join(f" - l{j}{r} * l{j}{r} * v{r}" for r in range(1, j))
            src = cte(f"{src}_v{j}", f"SELECT *, {v} AS v{j} FROM {src}")
            below = [f"(k{i}{j}" + "".join(f" - l{i}{r} * l{j}{r} * v{r}" for r in range(1, j)) + f") / v{j} AS l{i}{j}" for i in dims if i > j]
            if below:
                src = cte(f"{src}_l", f"SELECT *, {', '.join(below)} FROM {src}")
        cols = [f"m{i}" for i in dims] + [f"v{i}" for i in dims] + [f"l{i}{j}" for i, j in pairs if i != j]
        return cte(f"{src}_p", f"SELECT {keys}, {', '.join(cols)}, v1 * v2 * v3 * v4 AS det FROM {src}")

    def distances(name: str, params: str) -> str:
        z = cte(f"{name}_z1", f"SELECT x.*, p.* EXCLUDE (g), x1 / {unit}.0::DOUBLE - m1 AS z1 FROM x JOIN {params} p ON x.g = p.g")
        for i in dims[1:]:
            z = cte(f"{name}_z{i}", f"SELECT *, x{i} / {unit}.0::DOUBLE - m{i}" + "".join(f" - l{i}{j} * z{j}" for j in range(1, i)) + f" AS z{i} FROM {z}")
        return cte(f"{name}_d", "SELECT *, " + " + ".join(f"z{i} * z{i} / v{i}" for i in dims) + f" AS d2 FROM {z}")

    def moments(name: str, src: str, keys: str, factor: float) -> str:
        sums = ", ".join([f"sum(x{i})::DOUBLE / {unit} AS s{i}" for i in dims] + [f"sum(x{i} * x{j})::DOUBLE / {unit * unit} AS s{i}{j}" for i, j in pairs])
        a = cte(f"{name}_s", f"SELECT {keys}, count(*)::DOUBLE AS n, {sums} FROM {src} GROUP BY {keys}")
        b = cte(f"{name}_m", f"SELECT *, {', '.join(f's{i} / n AS m{i}' for i in dims)} FROM {a}")
        k = ", ".join(f"{factor}::DOUBLE * (s{i}{j} / n - m{i} * m{j})" + (f" + {floor[i]}::DOUBLE * {floor[i]}::DOUBLE" if i == j else "") + f" AS k{i}{j}" for i, j in pairs)
        return solve(cte(f"{name}_k", f"SELECT {keys}, {', '.join(f'm{i}' for i in dims)}, {k} FROM {b}"), keys)

    cte("d", "SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents")
    cte("w", r"SELECT doc_id, list_filter(string_split_regex(t, '[ \t-\r]+'), lambda a: a <> '') AS words, list_filter(string_split(t, chr(10)), lambda a: regexp_matches(a, '[^ \t-\r]')) AS lines, length(regexp_replace(t, '[ \t-\r]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d")
    cte("p", "SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w")
    cte("r", "SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS c FROM p")
    cte("c", "SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id")
    cte("s", "SELECT w.doc_id, len(words)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c ON w.doc_id = c.doc_id")
    cte("b", "SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s")
    cte("g0", "SELECT coalesce('=' || lang, '-') AS l, coalesce('=' || lang, '-') || ' ' || coalesce('=' || source, '-') AS ls, b.* FROM b JOIN d ON b.doc_id = d.doc_id")
    cte("g1", "SELECT l, ls, count(*) AS n FROM g0 WHERE NOT base_failed GROUP BY l, ls")
    cte("g2", "SELECT *, sum(CASE WHEN n < 50 THEN n ELSE 0 END) OVER (PARTITION BY l) AS small FROM g1")
    cte("g3", "SELECT ls, n, CASE WHEN n >= 50 THEN 'source ' || ls WHEN small >= 50 THEN 'language ' || l ELSE 'rest' END AS g FROM g2")
    cte("g4", "SELECT ls, CASE WHEN g = 'rest' AND (SELECT sum(n) FROM g3 WHERE g = 'rest') < 50 THEN NULL ELSE g END AS g FROM g3")
    cte("v", f"SELECT g0.*, g, round(ln(word_chars / n_words) * {unit})::BIGINT AS x1, round(ln(1 + n_symbols / n_words) * {unit})::BIGINT AS x2, round(n_dup_lines / (n_lines + 5) * {unit})::BIGINT AS x3, round(n_repeat_words / (n_words + 100) * {unit})::BIGINT AS x4 FROM g0 LEFT JOIN g4 ON g0.ls = g4.ls")
    cte("x", "SELECT doc_id, g, x1, x2, x3, x4 FROM v WHERE g IS NOT NULL AND NOT base_failed")
    step = unit // 64
    med, mad = [], []
    for i in dims:
        h = cte(f"h{i}", f"SELECT g, b, sum(count(*)) OVER (PARTITION BY g ORDER BY b) AS upto, sum(count(*)) OVER (PARTITION BY g) AS n FROM (SELECT g, x{i} // {step} AS b FROM x) GROUP BY g, b")
        med.append(cte(f"med{i}", f"SELECT g, min(b) AS b{i} FROM {h} WHERE 2 * upto >= n GROUP BY g"))
        q = cte(f"q{i}", f"SELECT g, b, sum(count(*)) OVER (PARTITION BY g ORDER BY b) AS upto, sum(count(*)) OVER (PARTITION BY g) AS n FROM (SELECT x.g, abs(x{i} // {step} - b{i}) AS b FROM x JOIN med{i} ON x.g = med{i}.g) GROUP BY g, b")
        mad.append(cte(f"mad{i}", f"SELECT g, min(b) AS a{i} FROM {q} WHERE 2 * upto >= n GROUP BY g"))
    ks = ", ".join(f"(1.4826::DOUBLE * a{i} / 64.0::DOUBLE) * (1.4826::DOUBLE * a{i} / 64.0::DOUBLE) + {floor[i]}::DOUBLE * {floor[i]}::DOUBLE AS k{i}{j}" if i == j else f"0.0::DOUBLE AS k{i}{j}" for i, j in pairs)
    joined = med[0] + "".join(f" JOIN {t} USING (g)" for t in (*med[1:], *mad))
    one = solve(cte("st", f"SELECT g, {', '.join(f'b{i} / 64.0::DOUBLE AS m{i}' for i in dims)}, {ks} FROM {joined}"), "g")
    two = moments("cl", "x", "g", 1.0)
    par = cte("par0", f"SELECT 1 AS start, * FROM {one} UNION ALL BY NAME SELECT 2 AS start, * FROM {two}")
    for k in (1, 2, 3):
        dd = distances(f"e{k}", par)
        bb = cte(f"bb{k}", f"SELECT g, start, x1, x2, x3, x4, floor(32 * ln(1 + d2))::INT AS b FROM {dd}")
        hh = cte(f"hh{k}", f"SELECT g, start, b, sum(count(*)) OVER (PARTITION BY g, start ORDER BY b) AS upto, sum(count(*)) OVER (PARTITION BY g, start) AS n FROM {bb} GROUP BY g, start, b")
        nn = cte(f"nn{k}", f"SELECT g, start, min(b) AS most FROM {hh} WHERE 2 * upto >= n + 5 OR upto = n GROUP BY g, start")
        half = cte(f"half{k}", f"SELECT {bb}.* FROM {bb} JOIN {nn} USING (g, start) WHERE b <= most")
        par = moments(f"f{k}", half, "g, start", 2.11)
    best = cte("best", f"SELECT * EXCLUDE (start, det) FROM {par} QUALIFY row_number() OVER (PARTITION BY g ORDER BY det, start) = 1")
    inner = cte("inn", f"SELECT g, x1, x2, x3, x4 FROM {distances('ee', best)} WHERE d2 <= 11.143")
    last = cte("fin", f"SELECT * EXCLUDE (det) FROM {moments('ff', inner, 'g', 1.106)}")
    verdict = cte("verdict", f"SELECT doc_id, d2 <= 33.377 AS fine FROM {distances('zz', last)}")
    body = ",\n".join(f"{n} AS MATERIALIZED ({q})" for n, q in out)
    return f"WITH {body}\nSELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(fine, TRUE) AS kept FROM b LEFT JOIN {verdict} ON b.doc_id = verdict.doc_id"


OP9_SQL = _op9()
