"""Recursive descent from tokens to Spark SQL text (queries) and plain dictionaries (other statements).

Expressions become Spark SQL text whose functions have the dialect's meaning, so that Catalyst plans the whole query.
"""

from __future__ import annotations

from sparkloom.functions.scalar import like_pattern
from sparkloom.plans.dialect.lexer import DialectError, Token, tokens, unquote

_STOP = {
    "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "ON", "USING", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "SEMI", "ANTI", "AND", "OR", "NOT", "THEN", "ELSE", "WHEN",
    "END", "AS", "ASC", "DESC", "NULLS", "IS", "IN", "LIKE", "BETWEEN", "WITH", "INTO", "ROWS", "RANGE", "FOR", "VALUES", "SET",
}
#: AI functions of SELECT and the column of a scored relation that each reads.
_AI = {
    "AI_PREDICT": "prediction", "AI_PREDICT_VALUE": "prediction", "AI_PREDICT_CLASS": "prediction", "AI_PREDICT_CLUSTER": "prediction", "FORECAST": "prediction", "AI_PREDICT_PROBA": "probability", "AI_CONFIDENCE": "confidence",
    "AI_PREDICT_ANOMALY": "anomaly", "AI_ANOMALY": "anomaly", "AI_EXPLAIN": "explanation",
}
#: What PREDICT_USING_m(...) and its like read of model m.
_USING = {
    "PREDICT": "prediction", "FORECAST": "prediction", "CLUSTER": "prediction", "CLUSTER_ID": "prediction", "PROBABILITY": "probability", "PROBABILITIES": "probability", "CONFIDENCE": "confidence", "ANOMALY": "anomaly",
    "ANOMALY_SCORE": "anomaly", "RESIDUAL": "residual", "EXPLAIN": "explanation",
}
_WINDOW = {"ROW_NUMBER", "RANK", "DENSE_RANK", "NTILE", "LAG", "LEAD", "FIRST_VALUE", "LAST_VALUE"}


def lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(s: str) -> str:
    return "`" + s.strip("`").replace("`", "``") + "`"


class Parser:
    def __init__(self, text: str, known: frozenset[str] | set[str] = frozenset()):
        self.t, self.i, self.source = tokens(text), 0, text
        self.known = {n.upper(): n for n in known}  # models by name, callable as functions
        self.models: dict[str, set[str]] = {}  # models that the query's functions use, with what of them

    # --- tokens ---

    @property
    def now(self) -> Token:
        return self.t[self.i]

    def next(self) -> Token:
        t = self.t[self.i]
        self.i += 1
        return t

    def at(self, *words: str) -> bool:
        return all(self.t[min(self.i + k, len(self.t) - 1)].word == w and self.t[min(self.i + k, len(self.t) - 1)].kind in ("name", "op") for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise DialectError(f"expected {' '.join(words)} at {self.now.at}, not {self.now.text!r}")

    def ident(self) -> str:
        t = self.next()
        if t.kind != "name":
            raise DialectError(f"expected a name at {t.at}, not {t.text!r}")
        return t.text.strip("`")

    def number(self) -> float:
        sign = -1 if self.take("-") else 1
        t = self.next()
        if t.kind != "number":
            raise DialectError(f"expected a number at {t.at}")
        return sign * (float(t.text) if any(c in t.text for c in ".eE") else int(t.text))

    def string(self) -> str:
        t = self.next()
        if t.kind != "string":
            raise DialectError(f"expected text at {t.at}")
        return unquote(t.text)

    def value(self):
        """A literal of an option: number, text, truth value or word."""
        if self.now.kind == "string":
            return self.string()
        if self.now.kind == "number" or self.at("-"):
            return self.number()
        w = self.ident()
        return {"TRUE": True, "FALSE": False, "NULL": None}.get(w.upper(), w)

    def names(self) -> list[str]:
        """( a, b, ... ) or a single name."""
        if not self.take("("):
            return [self.ident()]
        out = [self.ident()]
        while self.take(","):
            out.append(self.ident())
        self.need(")")
        return out

    def numbers(self) -> list[float]:
        self.take("=")
        self.need("(")
        out = [self.number()]
        while self.take(","):
            out.append(self.number())
        self.need(")")
        return out

    def options(self) -> dict:
        """( k = v, ... )."""
        out = {}
        self.need("(")
        while not self.take(")"):
            k = self.ident().lower()
            self.need("=")
            out[k] = self.value()
            self.take(",")
        return out

    def end(self) -> None:
        self.take(";")
        if self.now.kind != "end":
            raise DialectError(f"unexpected {self.now.text!r} at {self.now.at}")

    # --- expressions ---

    def expr(self) -> str:
        out = self.conjunction()
        while self.take("OR"):
            out = f"({out} OR {self.conjunction()})"
        return out

    def conjunction(self) -> str:
        out = self.negation()
        while self.take("AND"):
            out = f"({out} AND {self.negation()})"
        return out

    def negation(self) -> str:
        return f"(NOT {self.negation()})" if self.take("NOT") else self.predicate()

    def predicate(self) -> str:
        left = self.sum()
        while True:
            no = "NOT " if self.at("NOT", "BETWEEN") or self.at("NOT", "IN") or self.at("NOT", "LIKE") else ""
            if no:
                self.next()
            if self.take("BETWEEN"):
                lo = self.sum()
                self.need("AND")
                left = f"({left} {no}BETWEEN {lo} AND {self.sum()})"
            elif self.take("IN"):
                self.need("(")
                if self.at("SELECT") or self.at("WITH"):
                    inner = self.select()
                else:
                    items = [self.expr()]
                    while self.take(","):
                        items.append(self.expr())
                    inner = ", ".join(items)
                self.need(")")
                left = f"({left} {no}IN ({inner}))"
            elif self.take("LIKE"):
                p = self.string()
                left = f"({left} {no}RLIKE {lit(like_pattern(p))})" if "[" in p else f"({left} {no}LIKE {lit(p)})"
            elif self.take("IS"):
                flip = self.take("NOT")
                if self.take("NULL"):
                    left = f"({left} IS {'NOT ' if flip else ''}NULL)"
                elif self.at("TRUE") or self.at("FALSE"):
                    same = f"({left} <=> {self.next().word})"
                    left = f"(NOT {same})" if flip else same
                else:
                    same = f"({left} <=> {self.sum()})"
                    left = f"(NOT {same})" if flip else same
            elif self.now.kind == "op" and self.now.text in ("=", "==", "!=", "<>", "<", "<=", ">", ">="):
                op = {"==": "=", "!=": "<>"}.get(self.now.text, self.now.text)
                self.next()
                left = f"({left} {op} {self.sum()})"
            else:
                return left

    def sum(self) -> str:
        out = self.product()
        while self.now.kind == "op" and self.now.text in ("+", "-", "||"):
            out = f"({out} {self.next().text} {self.product()})"
        return out

    def product(self) -> str:
        out = self.unary()
        while (self.now.kind == "op" and self.now.text in ("*", "/", "%")) or self.at("MOD"):
            op = self.next().text
            out = f"({out} {'%' if op.upper() == 'MOD' else op} {self.unary()})"
        return out

    def unary(self) -> str:
        if self.take("-"):
            return f"(-{self.unary()})"
        self.take("+")
        return self.primary()

    def primary(self) -> str:
        t = self.now
        if t.kind == "number":
            self.next()
            return t.text + ("D" if any(c in t.text for c in ".eE") else "")
        if t.kind == "string":
            return lit(self.string())
        if self.take("("):
            inner = self.select() if self.at("SELECT") or self.at("WITH") else self.expr()
            self.need(")")
            return f"({inner})"
        if t.word in ("TRUE", "FALSE", "NULL"):
            return self.next().word
        if self.take("CASE"):
            return self.case()
        if t.word in ("NOW", "CURRENT_TIMESTAMP", "CURRENT_DATE"):
            self.next()
            if self.take("("):
                self.need(")")
            return "current_date()" if t.word == "CURRENT_DATE" else "current_timestamp()"
        if t.kind != "name" or t.word in _STOP:
            raise DialectError(f"expected an expression at {t.at}, not {t.text!r}")
        if t.word in ("DATE", "TIMESTAMP") and self.t[self.i + 1].kind == "string":
            self.next()
            return f"{t.word} {lit(self.string())}"
        if self.t[self.i + 1].text == "(":
            return self.call()
        parts = [name(self.ident())]
        while self.take("."):
            parts.append("*" if self.take("*") else name(self.ident()))
        return ".".join(parts)

    def case(self) -> str:
        out = "CASE" if self.at("WHEN") else f"CASE {self.expr()}"
        while self.take("WHEN"):
            c = self.expr()
            self.need("THEN")
            out += f" WHEN {c} THEN {self.expr()}"
        if self.take("ELSE"):
            out += f" ELSE {self.expr()}"
        self.need("END")
        return out + " END"

    def call(self) -> str:
        own = self.ident()
        fn = own.upper()
        self.need("(")
        kind, _, used = fn.partition("_USING_")
        if fn in _AI and self.now.kind in ("string", "name"):
            model, what = self.string() if self.now.kind == "string" else self.ident(), _AI[fn]
            while self.take(","):  # arguments name the model's features, which come from the relation
                self.expr()
        elif used and kind in _USING or fn in self.known:
            model, what = (own[len(kind) + len("_USING_") :], _USING[kind]) if used else (own, "prediction")
            model = self.known.get(model.upper(), model)
            while not self.at(")"):
                self.expr()
                self.take(",")
        else:
            model = None
        if model is not None:
            self.need(")")
            if self.at("WITH", "("):
                self.next()
                self.options()
            self.models.setdefault(model, set()).add(what)
            return name(f"__ai_{model}_{what}")
        distinct = self.take("DISTINCT")
        args: list[str] = []
        if self.take("*"):
            args = ["*"]
        elif not self.at(")"):
            args.append(self.expr())
            while self.take(","):
                args.append(self.expr())
        self.need(")")
        if self.take("WITHIN", "GROUP"):
            self.need("(", "ORDER", "BY")
            e = self.expr()
            self.need(")")
            if fn == "PERCENTILE_CONT" and len(args) == 1:
                args = [e, args[0]]
        out = self.function(fn, args, distinct)
        if self.take("OVER"):
            out += " OVER " + self.over(fn)
        elif fn in _WINDOW:
            raise DialectError(f"{fn} needs OVER")
        return out

    def function(self, fn: str, a: list[str], distinct: bool) -> str:
        """The dialect's meaning in Spark SQL."""
        if fn == "SUBSTR" or fn == "SUBSTRING":
            s, st = a[0], a[1]
            n = a[2] if len(a) > 2 else f"length({s})"
            return f"CASE WHEN {s} IS NULL THEN NULL WHEN {st} < 1 OR {st} > length({s}) OR {n} < 0 THEN '' ELSE substring({s}, {st}, {n}) END"
        if fn == "LENGTH":
            return f"CAST(octet_length({a[0]}) AS BIGINT)"
        if fn in ("YEAR", "MONTH", "DAY"):
            return f"{fn.lower()}(try_to_timestamp(CAST({a[0]} AS STRING)))"
        if fn == "JULIANDAY":
            t = "current_timestamp()" if a[0].lower() == "'now'" else f"try_to_timestamp(CAST({a[0]} AS STRING))"
            return f"(unix_date(CAST({t} AS DATE)) + 2440587.5D + (hour({t}) * 3600 + minute({t}) * 60 + second({t})) / 86400D)"
        if fn in ("STDDEV", "VARIANCE"):
            return f"CASE WHEN count({a[0]}) >= 2 THEN {'stddev_pop' if fn == 'STDDEV' else 'var_pop'}({a[0]}) END"
        if fn == "PERCENTILE_CONT":
            return f"percentile({a[0]}, {a[1] if len(a) > 1 else '0.5D'})"
        if fn == "CORR":
            x, y = (f"IF({a[0]} IS NOT NULL AND {a[1]} IS NOT NULL, CAST({v} AS DOUBLE), NULL)" for v in a)
            return f"coalesce(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0D), 0D)"
        if fn == "REGR_SLOPE":  # the first argument is the independent one
            x, y = (f"IF({a[0]} IS NOT NULL AND {a[1]} IS NOT NULL, CAST({v} AS DOUBLE), NULL)" for v in a)
            return f"coalesce(covar_pop({x}, {y}) / nullif(var_pop({x}), 0D), 0D)"
        return f"{fn.lower()}({'DISTINCT ' if distinct else ''}{', '.join(a)})"

    def over(self, fn: str) -> str:
        self.need("(")
        parts, order = "", ""
        if self.take("PARTITION", "BY"):
            parts = "PARTITION BY " + ", ".join(self.list(self.expr))
        if self.take("ORDER", "BY"):
            order = "ORDER BY " + ", ".join(self.list(self.order_item))
        elif fn in ("RANK", "DENSE_RANK"):
            raise DialectError(f"{fn} needs ORDER BY")
        frame = ""
        if self.at("ROWS") or self.at("RANGE"):
            frame = self.next().word
            depth = 0
            while not (self.at(")") and depth == 0):
                frame += " " + self.next().text
        elif fn in ("FIRST_VALUE", "LAST_VALUE"):
            frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
        if fn == "ROW_NUMBER" and not order:
            order = "ORDER BY 1"
        self.need(")")
        return "(" + " ".join(x for x in (parts, order, frame) if x) + ")"

    def list(self, item) -> list[str]:
        out = [item()]
        while self.take(","):
            out.append(item())
        return out

    def order_item(self) -> str:
        e = self.expr()
        e += " DESC" if self.take("DESC") else " ASC" if self.take("ASC") else ""
        if self.take("NULLS"):
            e += " NULLS " + self.next().word
        return e

    # --- queries ---

    def select(self) -> str:
        """A whole query as Spark SQL text."""
        head = ""
        if self.take("WITH"):
            ctes = []
            while True:
                n = self.ident()
                self.need("AS", "(")
                ctes.append(f"{name(n)} AS ({self.select()})")
                self.need(")")
                if not self.take(","):
                    break
            head = "WITH " + ", ".join(ctes) + " "
        out = self.block()
        while self.at("UNION") or self.at("INTERSECT") or self.at("EXCEPT"):
            op = self.next().word + (" ALL" if self.take("ALL") else "")
            out += f" {op} {self.block()}"
        if self.take("ORDER", "BY"):
            out += " ORDER BY " + ", ".join(self.list(self.order_item))
        if self.take("LIMIT"):
            out += f" LIMIT {int(self.number())}"
        if self.take("OFFSET"):
            out += f" OFFSET {int(self.number())}"
        return head + out

    def block(self) -> str:
        if self.take("("):
            out = self.select()
            self.need(")")
            return f"({out})"
        self.need("SELECT")
        out = "SELECT " + ("DISTINCT " if self.take("DISTINCT") else "") + ", ".join(self.list(self.item))
        if self.take("FROM"):
            out += " FROM " + self.relation()
            while True:
                if self.take(","):
                    out += ", " + self.relation()
                    continue
                how = ""
                if self.take("INNER"):
                    how = "INNER"
                elif self.take("CROSS"):
                    how = "CROSS"
                elif self.at("LEFT") or self.at("RIGHT") or self.at("FULL"):
                    how = self.next().word
                    if self.at("SEMI") or self.at("ANTI"):
                        how += " " + self.next().word
                    else:
                        self.take("OUTER")
                if not self.take("JOIN"):
                    if how:
                        raise DialectError(f"expected JOIN at {self.now.at}")
                    break
                out += f" {how} JOIN {self.relation()}"
                if self.take("ON"):
                    out += f" ON {self.expr()}"
                elif self.take("USING"):
                    out += " USING (" + ", ".join(map(name, self.names())) + ")"
        if self.take("WHERE"):
            out += f" WHERE {self.expr()}"
        if self.take("GROUP", "BY"):
            out += " GROUP BY " + ", ".join(self.list(self.expr))
            if self.take("HAVING"):
                out += f" HAVING {self.expr()}"
        elif self.at("HAVING"):
            raise DialectError("HAVING needs GROUP BY")
        return out

    def relation(self) -> str:
        if self.take("("):
            out = f"({self.select()})"
            self.need(")")
        else:
            out = name(self.ident())
        if self.take("AS") or (self.now.kind == "name" and self.now.word not in _STOP):
            out += f" AS {name(self.ident())}"
        return out

    def item(self) -> str:
        if self.take("*"):
            return "*"
        e = self.expr()
        if self.take("AS") or (self.now.kind == "name" and self.now.word not in _STOP):
            e += f" AS {name(self.ident())}"
        return e

    def text_until(self, *stops: str) -> str:
        """The source text of an expression, kept as text (CHECK)."""
        start = self.now.at
        depth = 0
        while self.now.kind != "end" and not (depth == 0 and self.now.word in stops):
            depth += {"(": 1, ")": -1}.get(self.now.text, 0)
            self.next()
        return self.source[start : self.now.at].strip()
