"""Building blocks of the DuckDB queries: independent formulas, by series."""

from __future__ import annotations

from cellwise.plans.views import SQL

PRIOR = (0.2041, 0.05816, 1.415, 1.838, 0.0969)


def phi(z: str) -> str:
    """The normal distribution function by its confluent series; cut to 0 and 1 far out."""
    q = f"(({z}) * ({z}) / 2)"
    series = f"list_sum([exp(k * ln({q}) - lgamma(k + 1.5)) for k in range(0, 300)])"
    body = f"0.5 + exp(-{q}) / sqrt(2 * pi()) * ({z}) * sqrt(pi()) / 2 * {series}"
    return f"(CASE WHEN ({z}) IS NULL THEN NULL WHEN ({z}) = 0 THEN 0.5 WHEN ({z}) > 12 THEN 1.0 WHEN ({z}) < -12 THEN 0.0 ELSE {body} END)"


def psi(x: str) -> str:
    return (
        f"(ln({x} + 200) - 1 / (2 * ({x} + 200)) - 1 / (12 * ({x} + 200) * ({x} + 200))"
        f" - list_sum([1.0::DOUBLE / ({x} + k) for k in range(0, 200)]))"
    )


def psi1(x: str) -> str:
    y = f"({x} + 200)"
    return (
        f"(1 / {y} + 1 / (2 * {y} * {y}) + 1 / (6 * {y} * {y} * {y})"
        f" + list_sum([1.0::DOUBLE / (({x} + k) * ({x} + k)) for k in range(0, 200)]))"
    )


def gamma_p(a: str, x: str, terms: int = 600) -> str:
    return f"list_sum([exp(({a} + k) * ln({x}) - {x} - lgamma({a} + k + 1)) for k in range(0, {terms})])"


def rnd(x: str) -> str:
    return f"round(({x})::DOUBLE * 1.000000000001::DOUBLE, 6) + 0.0"


def big(x: str) -> str:
    """Six digits, or whole thousands where a denominator of 1e-7 makes the value huge."""
    return f"CASE WHEN {x} >= 1000 THEN round(({x})::DOUBLE, -3) ELSE {rnd(x)} END"


def cells(view: str, threshold: int = 1, min_events: int = 1, key: str = "", source: str | None = None) -> str:
    """CTEs up to ``c``: the cells of a view with margins, N and the position in data order; ``key`` groups them."""
    g = f"{key}, " if key else ""
    by = f"PARTITION BY {key} " if key else ""
    return f"""
    WITH rep AS ({source or SQL[view]}),
    s AS (SELECT {g}name, ae, sum(cnt)::BIGINT AS events FROM rep WHERE name IS NOT NULL AND ae IS NOT NULL GROUP BY {g}name, ae),
    w AS (SELECT *, sum(events) OVER (PARTITION BY {g}name) AS rp, sum(events) OVER (PARTITION BY {g}ae) AS ra FROM s),
    k AS (SELECT {g}name, ae, events FROM w WHERE rp >= {threshold} AND ra >= {threshold}),
    m AS (SELECT *, (sum(events) OVER (PARTITION BY {g}name))::BIGINT AS n1j, (sum(events) OVER (PARTITION BY {g}ae))::BIGINT AS ni1 FROM k),
    t AS (SELECT *, (sum(events) OVER ({by}))::DOUBLE AS n FROM m WHERE events > 0),
    c AS (SELECT {g}name, ae, events, n1j, ni1, n, events::DOUBLE AS n11, (n1j * ni1)::DOUBLE / n AS e,
          row_number() OVER ({by}ORDER BY ae, name) AS pos, (count(*) OVER ({by}))::DOUBLE AS m
          FROM t WHERE events >= {min_events})"""


def exponent(m: str) -> str:
    """The exponent a >= 1 with exp(lgamma(2a + 1) - 2 lgamma(a + 1)) - 1 = m / 400, by bisection; 1 up to m = 400."""
    start = "{'lo': 1.0::DOUBLE, 'hi': 64.0::DOUBLE}"
    middle = "((s.lo + s.hi) / 2)"
    low = f"exp(lgamma(2 * {middle} + 1) - 2 * lgamma({middle} + 1)) - 1 < {m} * 0.0025"
    step = f"CASE WHEN {low} THEN {{'lo': {middle}, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': {middle}}} END"
    return f"CASE WHEN {m} <= 400 THEN 1.0::DOUBLE ELSE list_reduce([{start} for k in range(0, 100)], lambda s, k: {step}).lo END"


def pi0(key: str = "") -> str:
    """The share of null hypotheses from ``p`` and the exponent ``ex``."""
    part = "WHEN least(p, 1 - p) * 2 >= 1 THEN 1e300 ELSE pow(-ln(1 - 2 * least(p, 1 - p)), ex)"
    by = f"PARTITION BY {key}" if key else ""
    return (
        f"CASE WHEN count(p) OVER ({by}) < count(*) OVER ({by}) THEN 1.0 ELSE "
        f"least(1.0, avg((CASE {part} END) / exp(lgamma(ex + 1))) OVER ({by})) END"
    )


def ratio_query(head: str, p_and_more: str, columns: str, key: str = "", own: bool = False) -> str:
    """A ratio model from ``c``: scores, rates by rank given to rows by position (or with ``own`` by rank), output."""
    g, by = (f"{key}, ", f"PARTITION BY {key} ") if key else ("", "")
    on = f"r.{key} = x.{key} AND " if key else ""
    return f"""{head},
    ms AS (SELECT m, {exponent('m')} AS ex FROM (SELECT DISTINCT m FROM c)),
    s1 AS (SELECT c.*, ex, n1j - n11 AS n10, ni1 - n11 + 1e-7::DOUBLE AS n01 FROM c JOIN ms USING (m)),
    s0 AS (SELECT *, n - (n11 + n10 + n01) AS n00 FROM s1),
    {p_and_more},
    s3 AS (SELECT *, {pi0(key)} AS pi0, row_number() OVER ({by}ORDER BY p ASC NULLS LAST, ae, name) AS rk,
           (count(*) FILTER (p <= 0.5) OVER ({by}))::DOUBLE AS kk FROM s2),
    r AS (SELECT {g}rk, least(1.0, CASE WHEN rk <= kk THEN pi0 * p * m / rk
          WHEN rk > 1 THEN pi0 * m / (2.0 * (rk - 1)) + 1 - kk / (rk - 1) END) AS fdr FROM s3)
    SELECT {'x.' + g if g else ''}{columns} FROM s3 x JOIN r ON {on}r.rk = x.{'rk' if own else 'pos'}"""


def ratio_columns(stat: str = "p", name: str = "p_value", fdr: str = "fdr") -> str:
    return (
        f'name AS "Product", ae AS "Adverse Event", n11 AS "Count", {rnd("e")} AS "Expected Count", {rnd(stat)} AS "{name}", '
        f'{rnd("ratio")} AS "PRR", n1j::DOUBLE AS "product margin", ni1::DOUBLE AS "event margin", '
        + (f"{rnd(fdr)} AS fdr" if fdr == "fdr" else f"{fdr} AS fdr")
    )


def prr_scores(relative_risk: float = 1.0) -> str:
    z = f"(lr - ln({relative_risk})) / sd"
    return f"""s2a AS (SELECT *, ln((n11 / n1j) / (n01 / (n01 + n00))) AS lr,
      sqrt(1 / n11 - 1.0::DOUBLE / n1j + 1 / n01 - 1 / (n01 + n00)) AS sd FROM s0),
    s2 AS (SELECT *, exp(lr) AS ratio, lr - 1.959963984540054::DOUBLE * sd AS lower_, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - {phi(z)})) AS p FROM s2a)"""


def ror_scores() -> str:
    return f"""s2a AS (SELECT *, CASE WHEN n10 > 0 THEN ln(n11 * n00 / (n10 * n01)) END AS lr,
      CASE WHEN n10 > 0 THEN sqrt(1 / n11 + 1 / n10 + 1 / n01 + 1 / n00) END AS sd FROM s0),
    s2 AS (SELECT *, exp(lr) AS ratio, lr - 1.959963984540054::DOUBLE * sd AS lower_, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - {phi('lr / sd')})) AS p FROM s2a)"""


def rfet_scores(mid: bool = False) -> str:
    """The tail of the hypergeometric distribution with the fourth cell one less."""
    choose = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
    log = f"{choose('n1j', 'k')} + {choose('(n - 1 - n1j)', '(ni1 - k)')} - {choose('(n - 1)', 'ni1')}"
    tail = f"list_sum([exp({log}) for k in range(events, least(n1j, ni1) + 1)])"
    if mid:
        tail = f"{tail} - 0.5 * exp({log.replace('k', 'events')})"
    return f"""s2 AS (SELECT *, CASE WHEN n10 > 0 THEN n11 * n00 / (n10 * n01) END AS ratio, least(1.0, {tail}) AS p FROM s0)"""


def error_rates(key: str = "", mirrored: bool = True) -> str:
    """CTE ``z`` from ``post`` in ``b``: running sums in data order, those of FNR and Sp from the other end."""
    by = f"PARTITION BY {key} " if key else ""
    run = lambda x: f"sum({x}) OVER ({by}ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    on = (f"d.{key} = o.{key} AND " if key else "") + ("o.pos = d.m + 1 - d.pos" if mirrored else "o.pos = d.pos")
    return f"""d AS (SELECT *, {run('post')} AS cp, {run('1 - post')} AS cr, sum(1 - post) OVER ({by}) AS ar FROM b),
    z AS (SELECT d.*, d.cp / d.pos AS fdr, o.cr / (d.m - d.pos + 1e-7::DOUBLE) AS fnr, d.cr / d.ar AS se, o.cp / (d.m - d.ar) AS sp
          FROM d JOIN d AS o ON {on})"""


def bayes_columns(stat: str, name: str, more: str = "") -> str:
    return (
        f'name AS "Product", ae AS "Adverse Event", n11 AS "Count", {rnd("e")} AS "Expected Count", {rnd(stat)} AS "{name}", '
        f'{rnd("n11 / e")} AS "count/expected", n1j::DOUBLE AS "product margin", ni1::DOUBLE AS "event margin", '
        f'{rnd("fdr")} AS fdr, {big("fnr")} AS "FNR", {rnd("se")} AS "Se", {rnd("sp")} AS "Sp"{more}'
    )


def own_rates() -> str:
    """CTE ``z`` from ``post`` in ``b``: sums run from the least posterior up; FNR and Sp are those of the cells left."""
    run = lambda x: f"sum({x}) OVER (ORDER BY post, ae, name ROWS UNBOUNDED PRECEDING)"
    return f"""d AS (SELECT *, row_number() OVER (ORDER BY post, ae, name) AS rk, {run('post')} AS cp, {run('1 - post')} AS cr,
        sum(1 - post) OVER () AS ar, sum(post) OVER () AS ap FROM b),
    z AS (SELECT *, cp / rk AS fdr, CASE WHEN rk < m THEN (ar - cr) / (m - rk + 1e-7::DOUBLE) ELSE 0 END AS fnr, cr / ar AS se, (ap - cp) / (m - ar) AS sp
          FROM d)"""


def quantile(p: float = 0.05) -> str:
    """The quantile of the mixture of two gamma distributions by bisection on its distribution function."""
    middle = "((s.lo + s.hi) / 2)"
    below = f"q * {gamma_p('s1', f'(t1 * {middle})', 400)} + (1 - q) * {gamma_p('s2', f'(t2 * {middle})', 400)} < {p}"
    step = f"CASE WHEN {below} THEN {{'lo': {middle}, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': {middle}}} END"
    start = "{'lo': 0.0::DOUBLE, 'hi': greatest(s1 / t1, s2 / t2)::DOUBLE}"
    return f"list_reduce([{start} for k in range(0, 45)], lambda s, k: {step}).lo"


def glm(alpha: float) -> str:
    """CTEs up to ``f``: ``c`` with the fitted ``mu`` of n11 ~ 1 + n1j + ni1 with a log link and variance mu + alpha mu^2.

    Newton's steps on margins over their largest, each a sum over all cells and a 3 x 3 system by Cramer's rule.
    """
    eta = "(it.c0 + it.c1 * g.x1 + it.c2 * g.x2)"
    det = "(a00 * (a11 * a22 - a12 * a12) - a01 * (a01 * a22 - a12 * a02) + a02 * (a01 * a12 - a11 * a02))"
    one = "(b0 * (a11 * a22 - a12 * a12) - a01 * (b1 * a22 - a12 * b2) + a02 * (b1 * a12 - a11 * b2))"
    two = "(a00 * (b1 * a22 - a12 * b2) - b0 * (a01 * a22 - a12 * a02) + a02 * (a01 * b2 - b1 * a02))"
    three = "(a00 * (a11 * b2 - b1 * a12) - a01 * (a01 * b2 - b1 * a02) + b0 * (a01 * a12 - a11 * a02))"
    return f"""g AS (SELECT *, n1j / (max(n1j) OVER ())::DOUBLE AS x1, ni1 / (max(ni1) OVER ())::DOUBLE AS x2 FROM c),
    it AS (
      SELECT 0 AS step, ln(avg(n11)) AS c0, 0.0::DOUBLE AS c1, 0.0::DOUBLE AS c2 FROM g
      UNION ALL
      SELECT step + 1, c0 + {one} / {det}, c1 + {two} / {det}, c2 + {three} / {det} FROM (
        SELECT step, c0, c1, c2, sum(w) AS a00, sum(w * x1) AS a01, sum(w * x2) AS a02, sum(w * x1 * x1) AS a11, sum(w * x1 * x2) AS a12,
               sum(w * x2 * x2) AS a22, sum(r) AS b0, sum(r * x1) AS b1, sum(r * x2) AS b2
        FROM (SELECT it.step, it.c0, it.c1, it.c2, g.x1, g.x2, exp({eta}) / (1 + {alpha} * exp({eta})) AS w,
                     (g.n11 - exp({eta})) / (1 + {alpha} * exp({eta})) AS r FROM it, g WHERE it.step < 40)
        GROUP BY step, c0, c1, c2)
    ),
    f AS (SELECT g.*, exp({eta}) AS mu FROM g, it WHERE it.step = 40)"""


def t_quantile(z: float, df: str) -> str:
    """Student's quantile from the normal one by its series in 1 / df; for hundreds of degrees of freedom."""
    terms = [
        ((z**3 + z) / 4), ((5 * z**5 + 16 * z**3 + 3 * z) / 96), ((3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384),
        ((79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160),
    ]
    return f"({z!r}::DOUBLE + " + " + ".join(f"{t!r}::DOUBLE / pow({df}, {i})" for i, t in enumerate(terms, 1)) + ")"


def one_hot_lasso(source: str, penalties: str) -> str:
    """CTEs up to ``w``: coefficients of products where each report has one, for the penalties of ``pen(ae, i, a)``.

    With exclusive indicators and a free intercept b the coefficient of a product with share p and rate r is
    r - b cut to zero by a / p, and b is where the sum of p (r - b), clipped to -a and a, is zero: a bisection.
    """
    middle = "((s.lo + s.hi) / 2)"
    total = f"list_sum(list_transform(shares, lambda x: greatest(-a, least(a, x.p * (x.r - {middle})))))"
    step = f"CASE WHEN {total} > 0 THEN {{'lo': {middle}, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': {middle}}} END"
    return f"""WITH rep AS ({source}), n AS (SELECT count(*)::DOUBLE AS n FROM rep),
    r AS (SELECT p.name, e.ae, p.c / n AS p, coalesce(k.c, 0) / p.c AS r, n FROM n, (SELECT name, count(*)::DOUBLE AS c FROM rep GROUP BY name) p
          CROSS JOIN (SELECT DISTINCT ae FROM rep) e LEFT JOIN (SELECT name, ae, count(*)::DOUBLE AS c FROM rep GROUP BY ALL) k
          ON k.name = p.name AND k.ae = e.ae),
    e AS (SELECT ae, any_value(n) AS n, list({{'p': p, 'r': r}}) AS shares, sum(p * r) AS mean, sum(p * r * (1 - r)) AS inner_, count(*) AS products FROM r GROUP BY ae),
    pen AS ({penalties}),
    b AS (SELECT e.ae, pen.i, pen.a, list_reduce([{{'lo': 0.0::DOUBLE, 'hi': 1.0::DOUBLE}} for k in range(0, 200)], lambda s, k: {step}).lo AS b
          FROM e JOIN pen USING (ae)),
    w AS (SELECT r.*, b.i, b.a, b.b, sign(r.r - b.b) * greatest(abs(r.r - b.b) - b.a / r.p, 0) AS w FROM r JOIN b USING (ae))"""


def bcpnn_scores(relative_risk: float = 1.0) -> str:
    """CTE ``b`` with ``post`` and ``lower_`` in closed form."""
    return f"""b0 AS (SELECT *, 1.0::DOUBLE + n1j AS p1, 1.0::DOUBLE + ni1 AS q1, 1 + n11 AS r1,
        1 + n11 + (n - n11 - 1 + (2 + n) * (2 + n) / ((1 + ni1) * (1.0::DOUBLE + n1j))) AS rr FROM c),
    b1 AS (SELECT *, ({psi('r1')} - {psi('rr')} - ({psi('p1')} + {psi('q1')} - 2 * {psi('(2 + n)')})) / ln(2) AS ic,
        sqrt({psi1('r1')} - {psi1('rr')} + {psi1('p1')} + {psi1('q1')} - 2 * {psi1('(2 + n)')}) / ln(2) AS sd FROM b0),
    b AS (SELECT *, {phi(f'(ln({relative_risk}) - ic) / sd')} AS post, ic - 1.959963984540054::DOUBLE * sd AS lower_ FROM b1)"""


def gps_scores(relative_risk: float = 1.0) -> str:
    """CTE ``b`` with ``post`` and ``eb`` for the fixed prior."""
    a1, b1, a2, b2, w = PRIOR

    def log_nb(a: float, b: float) -> str:
        return f"(lgamma(n11 + {a}) - lgamma({a}::DOUBLE) + {a} * ln({b} / ({b} + e)) + n11 * ln(e / ({b} + e)))"

    return f"""b0 AS (SELECT *, {log_nb(a1, b1)} AS l1, {log_nb(a2, b2)} AS l2 FROM c),
    b1 AS (SELECT *, 1 / (1 + (1 - {w}) / {w} * exp(l2 - l1)) AS q, n11 + {a1} AS s1, e + {b1} AS t1, n11 + {a2} AS s2, e + {b2} AS t2 FROM b0),
    b AS (SELECT *, q * {gamma_p('s1', f'({relative_risk} * t1)')} + (1 - q) * {gamma_p('s2', f'({relative_risk} * t2)')} AS post,
          (q * ({psi('s1')} - ln(t1)) + (1 - q) * ({psi('s2')} - ln(t2))) / ln(2) AS eb FROM b1)"""
