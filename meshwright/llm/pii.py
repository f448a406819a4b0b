"""Operator 7: personal data by weak supervision, in DataFrame and SQL functions only.

Candidates are the matches of strict patterns (email, ip, card, phone), of tighter ones that find what a failed strict match
has swallowed or that marks and tables have torn apart (card, phone), of looser ones (addresses written with ``(at)``, numbers without a leading plus), and
long strings of letters and digits (secret).  Four labelers vote on every candidate: the pattern with its checks, a gazetteer (top-level domains,
calling codes, issuer ranges, routable networks, key prefixes), and words of the context before and after it.  The counts of votes and shapes
over all documents (at most 5 kinds x 3 x 3 x 2 x 2 x 4 rows) go to expectation-maximisation, which estimates each
labeler's reliability per kind; its posteriors train a logistic classifier of spans, which sees the votes and the span's own shape.  Base spans always stay.
Further candidates that meet no base span are added from the probability on (at least 0.5) at which their expected precision, by the posteriors, is
``precision``; of those that overlap the first stays.

Positions come from splitting at the matches: lengths of what lies between and of the matches add up.  The patterns
are written without nested repeats, so that Java's matcher needs neither deep recursion nor quadratic time.

Defined results: null text is empty (and stays null where it is masked); documents without candidates get counts of 0, the digest of an empty string and
an empty list; rows are treated one by one, so repeated rows repeat and a doc_id, null or not, plays no part; an empty table gives an empty result; in reports extra
columns are not read, and masking keeps them, whatever their names.  Texts of any length are read whole; time grows with the product of one text's base spans and its
further candidates.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, texts

#: The kinds of base spans, and those that only the method finds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: Top-level domains, first digits of calling codes' zones, context words by kind.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "eu", "nl", "ch", "at", "us", "ca", "br", "mx")
CONTEXT = {
    "email": r"e-?mail|mailto|contact|kontakt|correo|courriel|adresse|dirección|write to|schreib|écri|escrib",
    "ip": r"\bip\b|server|serveur|servidor|host|address|adresse|dirección|client|cliente",
    "card": r"card|visa|mastercard|amex|credit|crédit|crédito|kredit|karte|carte|tarjeta|iban",
    "phone": r"phone|tel\b|tel[.:]|call|fax|mobil|móvil|handy|telefon|teléfono|téléphone|appel|llam|anruf|whatsapp",
    "secret": r"token|secret|key|password|passwd|bearer|auth|passwort|kennwort|schlüssel|mot de passe|jeton|clé|clave|contraseña|secreto",
}
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "sk_", "pk_", "xox", "glpat-", "AIza")
WORDS = "A-Za-z0-9._%+-"
LABEL = "A-Za-z0-9-"
#: Strict patterns, each the same language and leftmost matches as its plain form in KINDS' contract.
STRICT = {
    "email": rf"(?:(?<![{WORDS}])|\G)[{WORDS}]++@(?=[{LABEL}]+[.][{LABEL}])(?:(?![.](?![{LABEL}]))[A-Za-z0-9.-])+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++[.][0-9]++[.][0-9]++[.][0-9]++",
    "card": r"[0-9](?:(?![ -](?![0-9]))[0-9 -])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
TIGHT = {
    "card": r"(?<![0-9A-Za-z])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[^0-9A-Za-z\n]{1,6}[0-9]{2,4}[^0-9A-Za-z\n]{1,6}[0-9]{3}[^0-9A-Za-z\n]{0,5}[0-9]{2,4}(?![0-9])",
}
LOOSE = {
    "email": rf"(?<![{WORDS}@])[{WORDS}]++ ?[(\[]at[)\]] ?[{LABEL}]++(?: ?[(\[]dot[)\]] ?|[.])[A-Za-z]{{2,}}",
    "phone": r"(?<![0-9A-Za-z+.-])(?<![0-9+][ -])\(?[0-9]{3,5}\)?[ /.-][0-9]{3,4}[ .-][0-9]{3,5}(?![0-9A-Za-z.-])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_-]{20,}+(?![+/=@.])",
}
SPAN = "struct<kind:int,start:int,end:int,base:boolean,regex:int,gazetteer:int,before:int,after:int,shape:int>"
VOTES = ("kind", "regex", "gazetteer", "before", "after", "shape")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _matches(text: Column, pattern: str, chunk: int = 128) -> Column:
    """start, end, hit and the lower-case text before and after (up to 40 code points, to the next match) of every match.

    A position is the sum of all lengths before it: of whole chunks, and of what comes before it in its own chunk.
    """

    def placed(hits: Column) -> Column:
        return _let(F.split(text, pattern, -1), lambda pieces: with_pieces(hits, pieces))

    def with_pieces(hits: Column, pieces: Column) -> Column:
        return _let(F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.length(p) + F.length(h)), lambda lengths: with_lengths(hits, pieces, lengths))

    def with_lengths(hits: Column, pieces: Column, lengths: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / chunk).cast("int")), lambda k: _sum(F.slice(lengths, k * chunk + 1, F.lit(chunk))))
        return _let(sums, lambda each: _let(F.transform(each, lambda _, k: _sum(F.slice(each, F.lit(1), k))), lambda before: rows(hits, pieces, lengths, before)))

    def rows(hits: Column, pieces: Column, lengths: Column, before: Column) -> Column:
        def row(h: Column, i: Column) -> Column:
            end = F.get(before, F.floor(i / chunk).cast("int")) + _sum(F.slice(lengths, F.floor(i / chunk).cast("int") * chunk + 1, i % chunk + 1))
            return F.struct((end - F.length(h)).alias("start"), end.alias("end"), h.alias("hit"), F.lower(F.right(F.get(pieces, i), F.lit(40))).alias("before"), F.lower(F.left(F.coalesce(F.get(pieces, i + 1), F.lit("")), F.lit(40))).alias("after"))

        return F.transform(hits, row)

    none = F.array().cast("array<struct<start:int,end:int,hit:string,before:string,after:string>>")
    return F.when(text.rlike(pattern), _let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)).otherwise(none)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(hit, "[.]"), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= F.lit("255"))))
    if kind == "card":
        return F.length(_digits(hit)).between(16, 19) & F.call_function("luhn_check", _digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def _gazetteer(kind: str, hit: Column) -> Column:
    """1, -1 or 0 (no opinion)."""
    if kind == "email":
        return F.when(F.lower(F.regexp_extract(hit, "([A-Za-z]+)$", 1)).isin(*DOMAINS), 1).otherwise(0)
    if kind == "ip":
        first = F.split(hit, "[.]")[0]
        return F.when(first.isin("0", "10", "127", "255"), -1).otherwise(1)
    if kind == "card":
        return F.when(F.substring(_digits(hit), 1, 1).isin("3", "4", "5", "6"), 1).otherwise(-1)
    if kind == "secret":
        return F.when(hit.rlike(f"^(?:{'|'.join(PREFIXES)})"), 1).otherwise(0)
    return F.when(hit.startswith("+0"), -1).when(hit.startswith("+"), 1).otherwise(0)


def _shape(kind: str, hit: Column) -> Column:
    """0 to 3: how long the span is for its kind, and whether it is written evenly."""
    if kind == "email":
        return F.least(F.size(F.split(hit, "[.]")) - 1, F.lit(3))
    if kind == "secret":
        return F.when(hit.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 2).otherwise(0) + F.when(F.length(hit) >= 32, 1).otherwise(0)
    n = F.length(_digits(hit))
    return F.when(n < 8, 0).when(n <= 10, 1).when(n <= 15, 2).otherwise(3)


def _candidate(i: int, kind: str, regex: Column | int | None = None) -> Callable[[Column], Column]:
    """A match as a candidate; without a vote of the pattern it is a strict one: 2 if its checks hold (a base span), else 0."""

    def made(m: Column) -> Column:
        base = _valid(kind, m["hit"]) if regex is None else F.lit(False)
        vote = F.when(base, 2).otherwise(0) if regex is None else F.lit(regex) if isinstance(regex, int) else regex
        near = lambda side: m[side].rlike(CONTEXT[kind]).cast("int").alias(side)
        return F.struct(F.lit(i).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), base.alias("base"), vote.alias("regex"), _gazetteer(kind, m["hit"]).alias("gazetteer"), near("before"), near("after"), _shape(kind, m["hit"]).alias("shape"))

    return made


def _strict(text: Column) -> Column:
    """Candidates of the strict patterns as an array of SPAN, by kind and start."""
    parts = []
    for i, kind in enumerate(BASE):
        got = _matches(text, STRICT[kind])
        if kind == "card":
            got = F.filter(got, lambda m: F.length(_digits(m["hit"])).between(13, 19))
        parts.append(F.transform(got, _candidate(i, kind)).cast(f"array<{SPAN}>"))
    return F.concat(*parts)


def _passes(kind: str) -> Callable[[Column], Column]:
    return lambda m: _valid(kind, m["hit"])


def _further(text: Column) -> Column:
    """Candidates of the other patterns as an array of SPAN."""
    parts = []
    for i, kind in enumerate(KINDS):
        if kind in TIGHT:
            got = F.filter(_matches(text, TIGHT[kind]), _passes(kind))
            parts.append(F.transform(got, _candidate(i, kind, 1)).cast(f"array<{SPAN}>"))
        if kind in LOOSE:
            got = _matches(text, LOOSE[kind])
            if kind == "secret":
                got = F.filter(got, lambda m: m["hit"].rlike("[0-9]") & m["hit"].rlike("[A-Za-z]"))
            parts.append(F.transform(got, _candidate(i, kind, 0 if kind == "phone" else 1)).cast(f"array<{SPAN}>"))
    return F.concat(*parts)


def _meets(spans: Column, s: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def _spans(text: Column) -> Column:
    """All candidates of a text as an array of SPAN; those that meet a base span are left out."""
    is_base = lambda s: s["base"]

    def with_strict(found: Column) -> Column:
        return _let(F.filter(found, is_base), lambda base: F.concat(base, F.filter(F.concat(F.filter(found, lambda s: ~s["base"]), _further(text)), lambda s: ~_meets(base, s))))

    return _let(_strict(text), with_strict)


#: P(vote | personal), P(vote | not) of each labeler at first: each is taken to be better than chance.
FIRST = (
    {2: (0.75, 0.1), 1: (0.2, 0.2), 0: (0.05, 0.7)},
    {1: (0.7, 0.4), 0: (0.25, 0.4), -1: (0.05, 0.2)},
    {1: (0.4, 0.05), 0: (0.6, 0.95)},
    {1: (0.2, 0.05), 0: (0.8, 0.95)},
)


def reliabilities(patterns: list[tuple], rounds: int = 50) -> dict[tuple, float]:
    """Posterior that a candidate is personal data for each pattern (VOTES), by expectation-maximisation over their counts."""
    post = {}
    for kind in {p[0] for p, _ in patterns}:
        rows = [(p, n) for p, n in patterns if p[0] == kind]
        prior, rel = 0.7, list(FIRST)
        q: dict[tuple, float] = {}
        for _ in range(rounds):
            for p, _n in rows:
                a, b = prior, 1 - prior
                for r, v in zip(rel, p[1:5], strict=True):
                    a, b = a * r[v][0], b * r[v][1]
                q[p] = a / (a + b)
            total = sum(n for _, n in rows)
            yes = sum(n * q[p] for p, n in rows)
            prior = (yes + 7) / (total + 10)
            # smoothed by what was taken at first, as ten candidates
            rel = [{v: ((sum(n * q[p] for p, n in rows if p[i + 1] == v) + 10 * f[v][0]) / (yes + 10), (sum(n * (1 - q[p]) for p, n in rows if p[i + 1] == v) + 10 * f[v][1]) / (total - yes + 10)) for v in f} for i, f in enumerate(FIRST)]
        post |= q
    return post


def _inputs(kind: int, regex: int, gazetteer: int, before: int, after: int, shape: int) -> list[float]:
    return [*(float((kind, regex) == (k, r)) for k in range(len(KINDS)) for r in range(3)), float(gazetteer == 1), float(gazetteer == -1), float(before), float(after), *(float(shape == k) for k in range(1, 4))]


def trained(patterns: list[tuple], post: dict[tuple, float], rounds: int = 1500, decay: float = 1e-4) -> list[float]:
    """Weights of the logistic span classifier, fitted to the posteriors of the patterns, weighted by the roots of their counts."""
    rows = [(_inputs(*p), post[p], math.sqrt(n)) for p, n in patterns]
    w = [0.0] * len(_inputs(*[0] * len(VOTES)))
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(rounds):
        grad = [decay * x for x in w]
        for x, y, n in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
            for i, a in enumerate(x):
                grad[i] += n * (p - y) * a / total
        w = [a - 2.0 * g for a, g in zip(w, grad, strict=True)]
    return w


def fitted(found: DataFrame, precision: float) -> dict[tuple, float]:
    """The patterns whose candidates are added beside the base spans, with their probabilities: the likeliest ones, as long as each is likelier than not and their expected precision holds."""
    seen = found.select(F.explode("cands").alias("s")).groupBy(*[F.col(f"s.{v}") for v in VOTES]).count().collect()  # at most 720 rows
    patterns = sorted((tuple(r[:-1]), r[-1]) for r in seen)
    post = reliabilities(patterns)
    w = trained(patterns, post)
    ranked = sorted(((1 / (1 + math.exp(-sum(a * b for a, b in zip(w, _inputs(*p), strict=True)))), p, n) for p, n in patterns if p[1] < 2), reverse=True)
    kept, right, total = {}, 0.0, 0
    for q, p, n in ranked:
        right, total = right + n * min(q, post[p]), total + n
        if q < 0.5 or right < precision * total:
            break
        kept[p] = q
    return kept


def _chosen(cands: Column, kept: dict[tuple, float]) -> Column:
    """base and spans (arrays of kind, start, end by kind and start) of an array of candidates."""
    place = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    code = lambda p: sum((int(v) + 1) * 8**i for i, v in enumerate(p))
    known = F.array(*[F.lit(code(p)) for p in sorted(kept)]).cast("array<int>")
    votes = lambda s: sum(((s[v] + 1) * 8**i for i, v in enumerate(VOTES)), F.lit(0))
    more = F.array_sort(F.transform(F.filter(cands, lambda s: ~s["base"] & F.array_contains(known, votes(s).cast("int"))), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    apart = F.aggregate(more, none, lambda acc, s: F.when((F.size(acc) == 0) | (F.get(acc, F.size(acc) - 1)["end"] <= s["start"]), F.array_append(acc, place(s))).otherwise(acc))
    return _let(F.array_sort(F.transform(F.filter(cands, lambda s: s["base"]), place)), lambda base: F.struct(base.alias("base"), F.array_sort(F.concat(base, apart)).alias("spans")))


def candidates(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", _spans(F.col("text")).alias("cands"))


def spans(docs: DataFrame, precision: float = 0.9) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) of each document."""
    found = stored(candidates(docs))
    return found.select("doc_id", _chosen(F.col("cands"), fitted(found, precision)).alias("x")).select("doc_id", "x.base", "x.spans")


def _joined(column: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, precision: float = 0.9) -> DataFrame:
    """Per document: counts of base spans by kind, their digest, all spans as a string, and their number."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE[k]}")
    return spans(docs, precision).select("doc_id", *[count(k) for k in range(len(BASE))], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def _merged(found: Column) -> Column:
    """start, end and kind of the stretches that spans cover: of those that overlap the first gives the kind."""
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    last = lambda acc: F.get(acc, F.size(acc) - 1)

    def step(acc: Column, s: Column) -> Column:
        longer = F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"), last(acc)["kind"].alias("kind"))
        return F.when((F.size(acc) == 0) | (last(acc)["end"] <= s["start"]), F.array_append(acc, s)).otherwise(F.array_append(F.slice(acc, F.lit(1), F.size(acc) - 1), longer))

    by_start = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.aggregate(by_start, none, step)


def _masked(text: Column, found: Column) -> Column:
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def put(m: Column) -> Column:
        before = lambda i: F.coalesce(F.get(m, i - 1)["end"], F.lit(0))
        pieces = F.transform(m, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), F.get(names, s["kind"])))
        end = F.get(m, F.size(m) - 1)["end"]
        return F.concat(F.array_join(pieces, ""), F.substring(text, end + 1, F.length(text)))

    return F.when(F.size(found) > 0, _let(_merged(found), put))


def masked(docs: DataFrame, precision: float = 0.9) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; n_chars follows the text.

    The texts are searched twice, first for the counts that the classifier needs, so that no row has to find its spans by a join.
    """
    kept = fitted(stored(candidates(docs)), precision)
    new = "_text"
    while new in docs.columns:
        new += "_"
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn(new, _masked(text, _chosen(_spans(text), kept)["spans"]))
    out = {"text": F.coalesce(new, "text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(new).isNotNull(), F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return rows.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
