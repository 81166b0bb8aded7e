"""Secret scan: fixed patterns plus a linear-chain conditional random field.

Tokens are runs of [A-Za-z0-9+/_.-], with up to two equals signs behind where nothing goes on after them. The CRF tags each as B (a secret begins), I (it goes on) or O, from the token's
shape, its neighbouring words and features of the whole file, and Viterbi decodes the best tag sequence. It runs over
all tokens of every passage: BEFORE tokens in front of and AFTER tokens behind each token that can hold a secret by
itself (not `plain`: under 8 characters, or under 20 without a digit) and each word of credentials (`_CUE`). Passages that
meet are one. Within them plain tokens are tagged like all others; tokens outside of passages are O.

The model is trained on the driver by maximum likelihood: on lines of a seeded generator, and on at most SAMPLE
passages of the table around pattern matches (smallest hashes first). Of the latter only the patterns' matches are
labelled, as secrets; the tags of their other tokens are summed over, for nobody has said what those are. What the
patterns find always stays; the CRF adds spans that touch none of it.

Defined results: null text is the empty text without spans; positions are code points of the whole text, end
exclusive; null and repeated identifiers are rows like any other; an empty table gives an empty result, and then the
model rests on the generator alone.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import ship, stage

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+(?:={1,2}(?![A-Za-z0-9+/_.=-]))?")
_NEAR = re.compile(r"[^\W\d_]+|[^\w\s]")
#: Bound of the sample of passages that training reads from the table.
SAMPLE = 400
SEED = 11
TAGS = 3  # O, B, I
_KEYS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
_IS_TOKEN = bytes(ord("a") if chr(i) in string.ascii_letters + string.digits + "+/_=.-" else 32 for i in range(256))
_IS_HEX = bytes(ord("h") if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_DIGIT = re.compile(rb"[0-9]")
BEFORE, AFTER = 4, 12
_CUE = re.compile(r"passw|passphrase|\bpass\b|pwd|secret|token|api[ _-]?key|bearer|credential|authorization|private[ _-]key|access[ _-]key", re.A | re.I)
#: Names of what a value is asked for.
ASKED = frozenset("password passwd passphrase pass pwd secret token bearer apikey credential credentials".split())
#: Words before a token that are kept by name; others are one feature.
CUES = frozenset("password passwd passphrase pass pwd secret token key apikey api auth authorization bearer credential credentials private access client signature jwt session cookie hash id uuid phone tel call iban card ip version date".split())
STARTS = ("AKIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "sk-", "pk_live_", "xoxb-", "xoxp-", "eyJ", "AIza", "npm_", "SG.", "ya29.", "ssh-", "http", "www.")


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out = []
    low = raw.lower()
    if any(k in low for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in raw.translate(_IS_HEX):
        out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    out.sort()
    return out


def plain(token: str) -> bool:
    n = len(token)
    return n < 8 or n < 20 and not any(c.isdigit() for c in token)


def runs(text: str) -> list[list[tuple[int, int]]]:
    """All tokens of each passage around tokens that aren't plain and words of credentials."""
    tokens: list[tuple[int, int]] = []
    near: list[int] = []
    for m in TOKEN.finditer(text):
        s, e = m.span()
        while e > s and text[e - 1] in ".-":  # sentence ends and dashes don't belong to a token
            e -= 1
        if e > s:
            if e - s >= 8 and not plain(text[s:e]):
                near.append(len(tokens))
            tokens.append((s, e))
    cues = [m.start() for m in _CUE.finditer(text)]
    if cues:
        starts = [s for s, _ in tokens]
        near = sorted({*near, *(max(0, bisect_right(starts, c) - 1) for c in cues)}) if starts else []
    out: list[list[tuple[int, int]]] = []
    end = 0
    for k in near:
        a, b = max(0, k - BEFORE), min(len(tokens), k + AFTER + 1)
        if out and a <= end:
            out[-1] += tokens[end:b]
        else:
            out.append(tokens[a:b])
        end = max(end, b)
    return out


def _level(x: float, cuts: tuple) -> int:
    return sum(x >= c for c in cuts)


def file_features(text: str, n_runs: int) -> list[str]:
    n = max(len(text), 1)
    code = sum(text.count(c) for c in "{};()<>")
    return [f"file:code{_level(code / n, (0.005, 0.02))}", f"file:eq{_level(text.count('=') / n, (0.001, 0.01))}", f"file:runs{_level(n_runs, (2, 5, 20))}"]


def features(text: str, s: int, e: int, of_file: list[str]) -> list[str]:
    w = text[s:e]
    n = len(w)
    digits = sum(c.isdigit() for c in w)
    upper, lower = sum(c.isupper() for c in w), sum(c.islower() for c in w)
    kinds = ("d" if digits else "") + ("u" if upper else "") + ("l" if lower else "") + "".join(c for c in "+/_=.-" if c in w)
    turns = sum((a.isdigit(), a.isupper()) != (b.isdigit(), b.isupper()) for a, b in zip(w, w[1:]))
    counts = Counter(w)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    out = ["bias", f"kinds:{kinds}", f"len:{_level(n, (10, 14, 18, 20, 24, 32, 36, 40, 41, 64, 100))}", f"digits:{_level(digits / n, (0.01, 0.1, 0.2, 0.35, 0.6, 0.9))}", f"turns:{_level(turns / n, (0.05, 0.15, 0.25, 0.4))}", f"entropy:{_level(entropy, (2, 2.5, 3, 3.5, 4, 4.5))}"]
    out += [f"len:{_level(n, (10, 14, 18, 24, 40))}|turns:{_level(turns / n, (0.15, 0.25))}|d{_level(digits / n, (0.1, 0.6))}"]
    out += [f"short:{n}" if n < 8 else "plain"] if plain(w) else []
    out += [f"start:{p}" for p in STARTS if w.startswith(p)]
    if all(c in "0123456789abcdefABCDEF-" for c in w):
        out.append("hex")
    if not (upper or lower):
        out.append("numeric")
    before, after = _NEAR.findall(text[max(0, s - 40) : s])[-4:], _NEAR.findall(text[e : e + 30])[:2]
    marks = [x for x in before if not x[0].isalpha()]
    named = [x.lower() for x in before if x[0].isalpha()]
    glued = s > 0 and not text[s - 1].isspace()
    out.append(f"glued:{text[s - 1]}" if glued else "apart")
    last = named[-1] if named else ""
    if last in ASKED and not any(x in ".," for x in marks[-1:]):
        own = "l" if not (digits or upper) else "capital" if not digits and upper == 1 and w[0].isupper() else "other"
        tie = "".join(x for x in before[-2:] if not x[0].isalpha())[:1] or ("bearer" if last == "bearer" else "none")
        out += [f"asked:{tie}", f"asked:{tie}|{own}"]
    out.append("mark:" + (marks[-1] if marks and not before[-1][0].isalpha() else "none"))
    out += ["assigned"] if any(m in "=:" for m in marks[-2:]) else []
    out += [f"cue:{x}" for x in named[-2:] if x in CUES] or ["cue:none"]
    out.append("next:" + (after[0] if after and not after[0][0].isalpha() else "word"))
    return out + of_file


class Model:
    """Weights of tag features and transitions; O to I is forbidden, a run starts and ends in O."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        self._rows = weights.tolist()

    def scores(self, feats: list[str]) -> list[float]:
        o = b = i = 0.0
        for f in feats:
            k = self.names.get(f)
            if k is not None:
                x = self._rows[k]
                o += x[0]
                b += x[1]
                i += x[2]
        return [o, b, i]

    def viterbi(self, emitted: list[list[float]]) -> list[int]:
        move = self.moves.tolist()
        best, back = [move[0][j] + emitted[0][j] if j != 2 else -math.inf for j in range(TAGS)], []
        for e in emitted[1:]:
            step, row = [], []
            for j in range(TAGS):
                x = [best[i] + move[i][j] if not (i == 0 and j == 2) else -math.inf for i in range(TAGS)]
                k = max(range(TAGS), key=x.__getitem__)
                row.append(k)
                step.append(x[k] + e[j])
            best = step
            back.append(row)
        j = max(range(TAGS), key=lambda t: best[t] + move[t][0])
        tags = [j]
        for row in reversed(back):
            j = row[j]
            tags.append(j)
        return tags[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """The secrets that the model alone finds: B and its following I."""
        found = runs(text)
        if not found:
            return []
        of_file, out = file_features(text, len(found)), []
        for run in found:
            for (s, e), tag in zip(run, self.viterbi([self.scores(features(text, s, e, of_file)) for s, e in run])):
                if tag == 1:
                    out.append((s, e))
                elif tag == 2:
                    out[-1] = (out[-1][0], e)
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    k = x.max(axis, keepdims=True)
    return k.squeeze(axis) + np.log(np.exp(x - k).sum(axis))


class _Sequences:
    """Sequences by falling length, their tokens padded: where[i, j] is token j of sequence i in the flat order."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.length = lengths[self.order]
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])[self.order]
        self.most = int(self.length[0])
        self.many = [int((self.length > j).sum()) for j in range(self.most)]
        self.where = [first[:c] + j for j, c in enumerate(self.many)]

    def expect(self, em: np.ndarray, mv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected tags of every token and expected moves, by forward and backward in log space."""
        alpha, beta = np.zeros_like(em), np.zeros_like(em)
        alpha[self.where[0]] = mv[0] + em[self.where[0]]
        for j in range(1, self.most):
            here = self.where[j]
            alpha[here] = _lse(alpha[here - 1][:, :, None] + mv, 1) + em[here]
        last = self.where[0] + self.length - 1
        beta[last] = mv[:, 0]
        for j in range(self.most - 2, -1, -1):
            after = self.where[j + 1]
            beta[after - 1] = _lse(mv[None] + (em[after] + beta[after])[:, None, :], 2)
        z = np.empty(len(self.length))
        z[:] = _lse(alpha[last] + mv[:, 0], 1)
        of = np.empty(len(em))
        for here in self.where:
            of[here] = z[: len(here)]
        prob = np.exp(np.minimum(alpha + beta - of[:, None], 0))
        move = np.zeros((TAGS, TAGS))
        move[0] += prob[self.where[0]].sum(0)
        move[:, 0] += prob[last].sum(0)
        inner = np.concatenate(self.where[1:]) if self.most > 1 else np.zeros(0, int)
        if len(inner):
            move += np.exp(np.minimum(alpha[inner - 1][:, :, None] + mv + (em[inner] + beta[inner])[:, None, :] - of[inner, None, None], 0)).sum(0)
        return prob, move


def train(examples: list[tuple[str, list[tuple[int, int]]]], partly: list[tuple[str, list[tuple[int, int]]]] = (), rounds: int = 120, rate: float = 0.4, ridge: float = 0.02) -> Model:
    """Maximum likelihood by adaptive gradient steps over all runs at once.

    Of the texts in `partly` only the given secrets are known; the likelihood sums over the tags of their other tokens.
    """
    names: dict[str, int] = {}
    rows: dict[tuple, int] = {}
    row_of, free, lengths = [], [], []  # per token: row of features, and the penalty of each tag; per run: its length
    for known, texts in ((True, examples), (False, partly)):
        for text, secrets in texts:
            found = runs(text)
            of_file = file_features(text, len(found))
            for run in found:
                inside = None
                for s, e in run:
                    hit = next((k for k, (a, b) in enumerate(secrets) if a <= s and e <= b or s <= a < e), None)
                    tag = 0 if hit is None else 2 if hit == inside else 1
                    inside = hit
                    free.append([0.0] * TAGS if hit is None and not known else [0.0 if t == tag else -1e9 for t in range(TAGS)])
                    f = tuple(sorted(names.setdefault(x, len(names)) for x in features(text, s, e, of_file)))
                    row_of.append(rows.setdefault(f, len(rows)))
                lengths.append(len(run))
        if known:
            n_runs, n_tokens = len(lengths), len(row_of)
    flat = np.array([x for f in rows for x in f])
    width = np.array([len(f) for f in rows])
    starts = np.concatenate([[0], np.cumsum(width)[:-1]])
    row, penalty, n = np.array(row_of), np.array(free), len(lengths)
    seqs = _Sequences(np.array(lengths))
    w, m = np.zeros((len(names), TAGS)), np.zeros((TAGS, TAGS))
    gw, gm = np.full_like(w, 1e-6), np.full_like(m, 1e-6)
    banned = np.zeros((TAGS, TAGS))
    banned[0, 2] = -1e9
    wholly, hidden = _Sequences(np.array(lengths[:n_runs])), _Sequences(np.array(lengths[n_runs:])) if len(lengths) > n_runs else None
    told, told_moves = wholly.expect(penalty[:n_tokens], banned)  # one sequence of tags is left: the same whatever the weights
    for _ in range(rounds):
        em, mv = np.add.reduceat(w[flat], starts)[row], m + banned
        prob, moved = seqs.expect(em, mv)
        want, moves = told, told_moves
        if hidden:
            summed, more = hidden.expect((em + penalty)[n_tokens:], mv)
            want, moves = np.concatenate([told, summed]), told_moves + more
        off = want - prob
        grad = np.stack([np.bincount(flat, np.repeat(np.bincount(row, off[:, t], len(rows)), width), len(w)) for t in range(TAGS)], 1)
        move = moves - moved
        move[0, 2] = 0
        grad, move = grad / n - ridge * w / n, move / n - ridge * m / n
        gw += grad**2
        gm += move**2
        w += rate * grad / np.sqrt(gw)
        m += rate * move / np.sqrt(gm)
    return Model(names, w, m)


def generated(n: int = 2500, seed: int = SEED) -> list[tuple[str, list[tuple[int, int]]]]:
    """Labelled lines: secrets of several kinds in several settings, and look-alikes that are none."""
    rnd, out = random.Random(seed), []
    pick = lambda chars, a, b: "".join(rnd.choice(chars) for _ in range(rnd.randint(a, b)))
    alnum, b64, hexa = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef"

    def word() -> str:
        return pick("aeionrstlhd", 2, 9)

    secrets = [
        lambda: pick(hexa, 32, 64), lambda: pick(hexa.upper(), 32, 64), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16, 16), lambda: "ghp_" + pick(alnum, 36, 36),
        lambda: "sk_live_" + pick(alnum, 24, 24), lambda: "sk-" + pick(alnum, 40, 48), lambda: "xoxb-" + pick(string.digits, 11, 12) + "-" + pick(alnum, 24, 24), lambda: "AIza" + pick(alnum + "_", 35, 35),
        lambda: "eyJ" + pick(alnum, 20, 40) + "." + pick(alnum, 40, 80) + "." + pick(alnum + "_", 43, 43), lambda: pick(b64, 38, 42), lambda: pick(b64, 40, 64) + "==", lambda: "glpat-" + pick(alnum, 20, 20), lambda: pick(alnum, 24, 40),
    ]
    others = [
        lambda: pick(string.digits, 8, 19), lambda: f"{rnd.randint(1990, 2030)}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}", lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4)), lambda: f"+{rnd.randint(1, 99)}-{pick(string.digits, 3, 3)}-{pick(string.digits, 4, 8)}",
        lambda: f"{pick(hexa, 8, 8)}-{pick(hexa, 4, 4)}-{pick(hexa, 4, 4)}-{pick(hexa, 4, 4)}-{pick(hexa, 12, 12)}", lambda: f"http://www.{word()}.com/{word()}/{rnd.randint(1, 9999)}", lambda: f"{word()}.{word()}{rnd.randint(1, 99)}", lambda: word() + word() + word() + word(), lambda: f"{word()}_{word()}_{rnd.randint(1, 999)}",
        lambda: f"v{rnd.randint(1, 20)}.{rnd.randint(0, 20)}.{rnd.randint(0, 99)}-{word()}{rnd.randint(1, 9)}", lambda: f"/usr/{word()}/{word()}{rnd.randint(1, 9)}.{word()}", lambda: f"{word()}-{word()}-{word()}-{word()}", lambda: word().capitalize() + word() + word().upper() + word() + word(), lambda: f"{rnd.choice(['DE', 'FR', 'GB'])}{pick(string.digits, 18, 22)}", lambda: "=" * rnd.randint(8, 60), lambda: f"+{rnd.randint(1, 99)} ({pick(string.digits, 3, 3)}) {pick(string.digits, 3, 3)}-{pick(string.digits, 4, 4)}", lambda: f"{word()}.{rnd.randint(1, 99)}@{word()}{rnd.randint(0, 9)}.{word()}.com", lambda: "-".join(pick(string.digits, 4, 4) for _ in range(4)), lambda: rnd.choice("#@") + word() + word().capitalize() + pick(string.digits, 0, 4), lambda: f"{word()}{word().capitalize()}{pick(string.digits, 1, 4)}",
    ]
    lead = ["{w}://{w}:", "{w} {w} ", 'key = "', "secret: ", "Authorization: Bearer ", 'token="', "api key ", "{w} ", "{w}\n", "export AUTH={w}\nKEY=", '"client": "', "{w}, "]
    for _ in range(n):
        text, spans = "", []
        for _ in range(rnd.randint(1, 3)):
            text += " ".join(word() for _ in range(rnd.randint(0, 6))) + rnd.choice([" ", "\n", ": "])
            start = rnd.choice(lead)
            while "{w}" in start:
                start = start.replace("{w}", word(), 1)
            text += start
            bad = rnd.random() < 0.5
            in_url = "://" in start
            value = pick(alnum, 10, 24) if bad and in_url and rnd.random() < 0.7 else rnd.choice(secrets if bad else others)()
            parts = [value]
            if bad and rnd.random() < 0.08:  # a wrapped key, whose last line is mostly a short one
                parts += [pick(b64, 64, 64) for _ in range(rnd.randint(1, 4))]
                parts += [pick(b64, 4, 60) + "=" * rnd.randint(0, 2)] if rnd.random() < 0.8 else []
            whole = rnd.choice([" ", "\n"]).join(parts)
            if bad:
                spans.append((len(text), len(text) + len(whole)))
            text += whole + ("@" if in_url else rnd.choice(['"', " ", "\n", ". ", ", "])) + word() + " "
        out.append((text, spans))
    camel = lambda: "".join(word().capitalize() for _ in range(rnd.randint(2, 4)))
    mixed = lambda: "".join(rnd.choice(string.ascii_uppercase) + rnd.choice(string.ascii_lowercase) for _ in range(rnd.randint(4, 9)))
    passwords = [
        camel, mixed, lambda: pick(string.ascii_letters, 1, 6) + rnd.choice("@!#$%&*") + pick(alnum, 2, 8) + rnd.choice("@!#$%&*") + pick(string.digits, 1, 4), lambda: pick(string.ascii_letters, 1, 4) + rnd.choice("@!#$%&*") + pick(alnum, 3, 10),
        lambda: word() + pick(string.digits, 1, 4), lambda: pick(alnum, 10, 18),
    ]
    asks = ["pwd", "password", "Password", "passwd", "pass", "passphrase", "secret", "token", "db_password", "PASSWORD"]

    def prose(a: int, b: int) -> str:
        ends = rnd.random() < 0.3  # texts whose words are followed by runs of symbols
        return " ".join(rnd.choice((word(), word(), word(), word().capitalize())) + (rnd.choice("@!#$%&*|") * rnd.randint(1, 3) if ends and rnd.random() < 0.7 else "") for _ in range(rnd.randint(a, b)))

    for _ in range(n // 2):
        text, spans = prose(0, 8) + rnd.choice([" ", "\n", ". "]), []
        kind = rnd.random()
        if kind < 0.5:
            text += rnd.choice([rnd.choice(asks) + rnd.choice([" = ", ": ", "=", ' = "', "='", ' : "']), "Bearer ", "Authorization: Bearer "])
            value = rnd.choice((camel, mixed, *passwords[4:]))() if text.endswith("Bearer ") else rnd.choice(passwords)()
            spans.append((len(text), len(text) + len(value)))
            text += value + rnd.choice(['"', " ", "\n", ". ", ", ", "; "]) + prose(1, 10)
        else:
            cue = rnd.choice([*asks, "bearer", "Bearer", "credentials", "api key", "tokens", "secrets"])
            text += cue + rnd.choice([" ", " ", " ", ". ", ", ", ": ", "\n"]) + word() + " " if rnd.random() < 0.6 else prose(1, 4) + " "
            text += prose(0, 5) + rnd.choice([" ", rnd.choice("@!#$%&*|") * 3 + " ", ", "]) + rnd.choice((word, rnd.choice(others)))() + rnd.choice([" ", rnd.choice("@!#$%&*|") * 3 + " ", ". "]) + prose(1, 9)
        out.append((text, spans))
    return out


def sampled(docs: DataFrame, text_col: str, sample: int = SAMPLE) -> list[tuple[str, list[tuple[int, int]]]]:
    """At most `sample` passages around a text's first pattern match, with the patterns' matches.

    All texts offer theirs; those with the smallest hashes are taken. What else they hold is unlabelled.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            passage = []
            for t in b.column(0):
                text = t.as_py()
                raw = text.encode()
                spans = base_spans(text, raw)
                if spans:
                    s, _, e = spans[0]
                    passage.append(text[max(0, s - 100) : min(e, s + 300) + 100])
            yield pa.RecordBatch.from_arrays([pa.array(passage, pa.string())], names=["p"])

    offered = stage(docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).mapInArrow(run, "p string"), "passages")
    taken = [r.p for r in offered.distinct().orderBy(F.xxhash64("p"), "p").limit(sample).collect()]
    return [(p, [(s, e) for s, _, e in base_spans(p, p.encode())]) for p in taken]


def fit(docs: DataFrame | None = None, text_col: str = "text", sample: int = SAMPLE) -> Model:
    return train(generated(), sampled(docs, text_col, sample) if docs is not None else [])


def scan_text(text: str, model: Model) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans of one text, by start, then kind."""
    raw = text.encode()
    out = base_spans(text, raw)
    if _DIGIT.search(raw) or b"a" * 20 in raw.translate(_IS_TOKEN) or _CUE.search(text):
        taken = out[:]
        out += [(s, 3, e) for s, e in model.spans(text) if not any(a < e and s < b for a, _, b in taken)]
        out.sort()
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the array of spans (kind, start, end) of every whole text; one narrow Arrow pass."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan_text(t.as_py(), model)] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _ARROW)], names=[id_col, "spans"])

    return src.mapInArrow(run, T.StructType([src.schema[0], T.StructField("spans", SPANS)]))


def mask(text: str, spans: list[tuple[int, int, int]], by: str) -> str:
    out, at, end = [], 0, 0
    for s, _, e in spans:
        if s >= end:
            out += [text[at:s], by]
        at = end = max(end, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: Model, text_col: str = "text", by: str = "[secret]", chars_col: str | None = None) -> DataFrame:
    """docs with every span of every text replaced by a mark; other columns and texts without spans stay as they are.

    chars_col, if given, gets the new number of code points where a text has changed.
    """
    ship(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)
    chars = names.index(chars_col) if chars_col in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(at).to_pylist()
            new = [None if t is None else mask(t, scan_text(t, model), by) for t in old]
            cols = list(b.columns)
            cols[at] = pa.array(new, pa.string())
            if chars >= 0:
                cols[chars] = pa.array([k if x == y else len(y) for x, y, k in zip(old, new, cols[chars].to_pylist())], cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per pattern, SHA-256 of the pattern spans, and all spans as text."""
    text = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    count = lambda k: F.expr(f"CAST(size(filter(spans, x -> x.kind = '{k}')) AS BIGINT)").alias(f"n_{k}")
    return found.select(id_col, *map(count, KINDS[:3]), F.expr(f"sha2({text.format('filter(spans, x -> x.kind <> ' + repr('crf') + ')')}, 256)").alias("base_sha256"), F.expr(text.format("spans")).alias("spans"))
