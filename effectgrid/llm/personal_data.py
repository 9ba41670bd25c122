"""Personal data by weak-supervision aggregation.

Candidates are the spans of strict patterns and of looser forms: addresses with
a spelt-out at sign, phone numbers without a country code, other card lengths,
addresses of version 6. Five labelers vote yes, no or nothing on each: the
pattern's own validity, a gazetteer of what its parts may be, a checksum or
range, the words around it, and its boundaries. Only how often each pattern of
votes occurs is needed next: a grouped count over all texts, of bounded size.
On it expectation-maximisation estimates each labeler's reliability and each
candidate's chance to be right, and with these chances as labels a logistic
span classifier is trained. Spans of the strict patterns always stay; the
classifier decides on the others.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
FORMS = ("strict", "spelt", "local", "other")
LABELERS = 5
LEAST = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELT = re.compile(r"([A-Za-z0-9._%+-]{1,64})\s{0,2}[\[({]\s?at\s?[\])}]\s{0,2}([A-Za-z0-9-]{1,63}(?:\s{0,2}(?:\.|[\[({]\s?dot\s?[\])}])\s{0,2}[A-Za-z0-9-]{1,63}){1,8})", re.I)
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ ./-]{1,2}[0-9]{3,4}[ .-][0-9]{3,5}(?![0-9A-Za-z])")
_OTHER_CARD = re.compile(r"(?<![0-9A-Za-z.])[0-9](?:[ .-]?[0-9]){12,18}(?![0-9A-Za-z])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_ANY = re.compile(r"[0-9@]|[\[({]\s?at\s?[\])}]", re.I)
_RUN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_TOP_LEVEL = frozenset("com org net edu gov mil int info biz io eu de fr es it uk us ca ch at nl be pl pt ru br mx ar jp cn in au".split())
_ISSUERS = re.compile(r"4|5[1-5]|2(?:2[2-9]|[3-6]|7[01])|3[47]|3(?:0[0-5]|[68])|6(?:011|5)|35")
_NEAR = {
    "email": "mail email e-mail contact write kontakt courriel correo contacto schreiben",
    "ip": "ip host server address client adresse dirección login from",
    "card": "card visa mastercard amex credit payment karte carte tarjeta kreditkarte",
    "phone": "phone tel telephone call mobile fax cell telefon téléphone teléfono móvil handy anruf",
}
_NEAR = {k: frozenset(v.split()) for k, v in _NEAR.items()}
_AGAINST = frozenset("version v isbn issn order sku page pages section chapter figure table id no nr build release seite bestellung commande pedido".split())
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The strict spans by kind as listed, then start: leftmost, not overlapping within a kind."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:  # the part before an @ is the run that ends there, from the last match on
        begin = at
        while begin > last and text[begin - 1] in _RUN:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and (len(x) < 5 or not x[:-4].strip("0")) for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def other_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """Candidates of the looser forms that touch no strict span and not each other."""
    found = [("email", *m.span(), "spelt") for m in _SPELT.finditer(text)] if re.search(r"[\[({]\s?at\s?[\])}]", text, re.I) else []
    found += [("ip", *m.span(), "other") for m in _IP6.finditer(text)]
    found += [("card", *m.span(), "other") for m in _OTHER_CARD.finditer(text)]
    found += [("phone", *m.span(), "local") for m in _LOCAL_PHONE.finditer(text)]
    taken, out = sorted((a, b) for _, a, b in base), []
    for kind, a, b, form in found:
        if not any(x < b and a < y for x, y in taken):
            out.append((kind, a, b, form))
            taken.append((a, b))
    return out


def votes(text: str, kind: str, a: int, b: int, form: str) -> str:
    """One of y, n and - from each labeler."""
    span, d = text[a:b], _digits(text[a:b])
    tell = lambda x: "-" if x is None else "y" if x else "n"
    if kind == "email":
        end = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        gazetteer, checked = end in _TOP_LEVEL, None if form == "strict" else 2 <= len(end) <= 6
    elif kind == "ip":
        parts = span.split(".") if form == "strict" else []
        gazetteer = None if not parts else parts[0] not in ("0", "255")
        checked = None if form == "strict" else span.lower().count("0000") < 8
    elif kind == "card":
        gazetteer, checked = bool(_ISSUERS.match(d)), luhn(d)
    else:
        gazetteer, checked = (d[0] != "0" if form == "strict" else d[0] in "023456789"), 8 <= len(d) <= 15 if form == "strict" else 9 <= len(d) <= 12
    near = {w.lower() for w in _WORD.findall(text[max(0, a - 40) : a])[-4:]} | {w.lower() for w in _WORD.findall(text[b : b + 25])[:2]}
    context = True if near & _NEAR[kind] else False if near & _AGAINST else None
    before, after = text[a - 1 : a], text[b : b + 1]
    free = not (before.isalnum() or after.isalnum() or (before and before in "@_=/#-") or (after and after in "@_=/-"))
    return "".join(map(tell, (True if form == "strict" else None, gazetteer, checked, context, free)))


Pattern = tuple[str, str, str]


def reliabilities(counts: dict[Pattern, int], rounds: int = 50) -> tuple[dict[Pattern, float], np.ndarray]:
    """Chance of each pattern (kind, form, votes) to be right, and P(vote | class) of each labeler.

    Expectation-maximisation with a prior for each kind and form; it starts
    from the majority and keeps every labeler better than chance.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    code = np.array([["yn-".index(c) for c in p[2]] for p in patterns], np.int64).reshape(len(patterns), LABELERS)
    group = np.unique(["/".join(p[:2]) for p in patterns], return_inverse=True)[1] if patterns else np.zeros(0, int)
    yes, no = (code == 0).sum(axis=1), (code == 1).sum(axis=1)
    p = (yes + 0.5) / (yes + no + 1)
    table = np.zeros((LABELERS, 2, 3))
    for _ in range(rounds):
        for j in range(LABELERS):
            for y, w in ((1, p), (0, 1 - p)):
                c = np.bincount(code[:, j], weights=w * n, minlength=3) + 1.0
                table[j, y] = c / c.sum()
            # a labeler may be useless, not turned round
            ratio = lambda y: table[j, y, 0] / (table[j, y, 0] + table[j, y, 1])
            if ratio(1) < ratio(0):
                table[j, :, :2] = (table[j, :, :2].sum(axis=1, keepdims=True)) / 2
        prior = np.array([((p * n)[group == g].sum() + 1) / (n[group == g].sum() + 2) for g in range(group.max(initial=-1) + 1)])
        logs = np.stack([np.log(1 - prior[group]), np.log(prior[group])]) if len(patterns) else np.zeros((2, 0))
        for j in range(LABELERS):
            logs += np.log(table[j][:, code[:, j]])
        p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -30, 30)))
    return dict(zip(patterns, p.tolist())), table


def pattern_features(pattern: Pattern) -> np.ndarray:
    kind, form, vote = pattern
    x = np.zeros(1 + len(KINDS) + len(FORMS) + 2 * LABELERS)
    x[0] = x[1 + KINDS.index(kind)] = x[1 + len(KINDS) + FORMS.index(form)] = 1
    for j, c in enumerate(vote):
        if c != "-":
            x[1 + len(KINDS) + len(FORMS) + 2 * j + "yn".index(c)] = 1
    return x


def train(counts: dict[Pattern, int]) -> np.ndarray:
    """Weights of the span classifier, by Newton steps on the chances as soft labels; zeros without candidates."""
    chance, _ = reliabilities(counts)
    if not chance:
        return np.zeros(1 + len(KINDS) + len(FORMS) + 2 * LABELERS)
    x = np.stack([pattern_features(p) for p in chance])
    y, n = np.array(list(chance.values())), np.array([counts[p] for p in chance], float)
    n = np.minimum(n, n.mean() * 20 + 1) / n.mean()
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (q - y)) + 0.1 * w
        h = (x * (n * q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, g), -3, 3)
    return w


def _candidates(text: str) -> tuple[list, list]:
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    return base, other_spans(text, base)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for x in batch.column(1):
            text = x.as_py() or ""
            base, others = _candidates(text)
            for kind, a, b in base:
                counts[kind, "strict", votes(text, kind, a, b, "strict")] += 1
            for kind, a, b, form in others:
                counts[kind, form, votes(text, kind, a, b, form)] += 1
    rows = [(*k, n) for k, n in sorted(counts.items())]
    columns = list(zip(*rows)) if rows else [()] * 4
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["kind", "form", "votes", "n"])


_OUT = "id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"


def _found(weights: list[float]):
    w = np.array(weights)
    chance: dict[Pattern, bool] = {}

    def likely(pattern: Pattern) -> bool:
        if pattern not in chance:
            chance[pattern] = bool(1 / (1 + np.exp(-pattern_features(pattern) @ w)) > LEAST)
        return chance[pattern]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = x.as_py() or ""
                base, others = _candidates(text)
                added = [(k, a, b) for k, a, b, form in others if likely((k, form, votes(text, k, a, b, form)))]
                whole = sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1])) if added else base
                name = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
                n = Counter(k for k, _, _ in base)
                rows.append((i, *(n[k] for k in KINDS), hashlib.sha256(name(base).encode()).hexdigest(), name(whole), len(added)))
            columns = list(zip(*rows)) if rows else [()] * 8
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    Counts and base_sha256 are of the strict spans; spans lists these and the
    added ones as kind:start:end, by kind as listed, then start, in code points
    with an exclusive end. Null and empty texts have none. An empty table gives
    an empty result; other columns are not read.
    """
    docs = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").alias("text"))
    counted = docs.mapInArrow(_counted, "kind string, form string, votes string, n long")
    # at most kinds x forms x 3 ^ labelers rows
    rows = counted.groupBy("kind", "form", "votes").agg(F.sum("n").alias("n")).collect()
    weights = train({(r.kind, r.form, r.votes): r.n for r in rows})
    return docs.mapInArrow(_found(weights.tolist()), _OUT).withColumnRenamed("id", id_column)
