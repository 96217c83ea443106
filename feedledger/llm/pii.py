"""Personal data: patterns propose spans, checksums confirm them, context adjusts scores.

Column functions only. A text is cut by a pattern into gaps and matches (``split`` and
``regexp_extract_all`` agree on leftmost non-overlapping matches), so positions are running
lengths, and the words next to a match are the ends of its neighbouring gaps. Patterns use
possessive quantifiers, and start where a run of their characters starts, so that no text
makes them slow or deep.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .shared import fresh, let_sql


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: SQL over ``{t}``, the text: false only where the pattern can't match.
    gate: str
    #: SQL over ``m``, the matched text: whether the checks confirm it.
    check: str
    #: Score of a confirmed match, and what a context word nearby adds.
    score: float
    context: str
    bonus: float = 0.25


_DIGITS = "regexp_replace(m, '[ -]', '')"
#: Luhn over ``d``: from the right, every second digit doubled, digits of the double summed.
_LUHN = """aggregate(sequence(1, length(d)), 0, (s, i) -> s + (
    int(substr(d, -i, 1)) * (2 - i % 2) - IF(i % 2 = 0 AND int(substr(d, -i, 1)) > 4, 9, 0)))
    % 10 = 0"""
#: The account number with its first four characters last, letters as 10 to 35, modulo 97.
_MOD97 = """aggregate(sequence(1, length(d)), 0, (s, i) -> IF(
    substr(d, i, 1) BETWEEN '0' AND '9', (s * 10 + int(substr(d, i, 1))) % 97,
    (s * 100 + ascii(substr(d, i, 1)) - 55) % 97)) = 1"""

#: Account number lengths by country code.
_IBAN = {15: "NO", 16: "BE", 18: "DK FO FI FK GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
         21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
         24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
         28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC",
         33: "RU"}
#: A listed code fixes where the number ends; the general form is for others.
_IBAN_PATTERN = (r"(?=[A-Z])(?<![A-Za-z0-9])(?:"
                 + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?+[A-Z0-9]){{{n - 4}}}+" for n, c in _IBAN.items())
                 + f"|(?!{'|'.join(_IBAN.values()).replace(' ', '|')})"
                 + r"[A-Z]{2}[0-9]{2}(?: ?+[A-Z0-9]){11,30}+)(?![A-Za-z0-9])")


#: Patterns of the four base kinds as asked for, and of the account number.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         "contains({t}, '@')", "true", 0.9, "mail|contact|write|e-mail|correo|courriel|kontakt"),
    Kind("ip", r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
         "{t} RLIKE '[0-9]'",
         r"forall(split(m, '[.]'), p -> p RLIKE '^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$')",
         0.6, r"\bip\b|address|host|server|login|adresse"),
    Kind("card", r"[0-9](?:[ -]?+[0-9])++", "{t} RLIKE '[0-9]'",
         let_sql("d", _DIGITS, f"IF(length(d) BETWEEN 13 AND 19, {_LUHN}, false)"),
         0.7, "card|credit|visa|payment|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "contains({t}, '+')",
         "length(regexp_replace(m, '[^0-9]', '')) BETWEEN 9 AND 15",
         0.7, r"phone|call|tel\b|mobile|fax|telefon"),
    Kind("iban", _IBAN_PATTERN,
         "{t} RLIKE '[0-9]'",
         let_sql("d", "concat(substr(replace(m, ' ', ''), 5), substr(replace(m, ' ', ''), 1, 4))",
               f"IF(length(d) BETWEEN 15 AND 34, {_MOD97}, false)"),
         0.7, "iban|account|bank|konto|compte|cuenta"),
)
BASE = ("email", "ip", "card", "phone")
#: Characters of a gap that count as near a match.
NEAR = 40


def _running(lengths: str) -> str:
    """SQL: for an array of longs, the sum of all elements before each.

    In chunks of the square root of its length, as each step copies what it has built.
    """
    step = f"""aggregate(c, named_struct('t', o, 'a', array_repeat(0L, 0)),
        (s, x) -> named_struct('t', s.t + x, 'a', array_append(s.a, s.t))).a"""
    return let_sql("xs", lengths, let_sql(
        "w", "greatest(1, int(ceil(sqrt(size(xs)))))", let_sql(
            "cs", "transform(sequence(0, int(ceil(size(xs) / w)) - 1), k -> slice(xs, k * w + 1, w))",
            f"""flatten(zip_with(cs, aggregate(cs, named_struct('t', 0L, 'a', array_repeat(0L, 0)),
                (s, c) -> named_struct('t', s.t + aggregate(c, 0L, (p, x) -> p + x),
                                       'a', array_append(s.a, s.t))).a,
                (c, o) -> {step}))""")))


def _spans(text: str, kind: Kind) -> str:
    """SQL: array of ``(kind, start, end, score)`` of one kind's confirmed matches."""
    p = kind.pattern.replace("\\", "\\\\").replace("'", "\\'")
    look = kind.context.replace("\\", "\\\\")
    near = (f"(lower(right(g.b, {NEAR})) RLIKE '{look}' OR lower(left(g.a, {NEAR})) RLIKE '{look}')")
    found = f"""transform(zip_with(arrays_zip(ms, {_running('zip_with(ms, slice(gs, 1, size(ms)), (m, g) -> bigint(length(m) + length(g)))')}),
            zip_with(slice(gs, 1, size(ms)), slice(gs, 2, size(ms)), (b, a) -> named_struct('b', b, 'a', a)),
            (m, g) -> named_struct('m', m.ms, 's', m.`1` + length(g.b), 'g', g)),
        r -> named_struct('kind', '{kind.name}', 'start', r.s, 'end', r.s + length(r.m),
            'score', {kind.score} + IF({near.replace('g.', 'r.g.')}, {kind.bonus}, 0D),
            'ok', {let_sql('m', 'r.m', kind.check)}))"""
    none = "filter(array(named_struct('kind', '', 'start', 0L, 'end', 0L, 'score', 0D)), x -> false)"
    body = f"""IF(size(ms) = 0, {none}, {let_sql('gs', f"split({text}, '{p}', -1)",
        f"transform(filter({found}, r -> r.ok), r -> named_struct('kind', r.kind, 'start', r.start, 'end', r.end, 'score', double(r.score)))")})"""
    gate = kind.gate.format(t=text)
    return let_sql("ms", f"IF({gate}, regexp_extract_all({text}, '{p}', 0), array_repeat('', 0))", body)


def pii_spans(text: str, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """All confirmed spans of a text column, by kind as listed, then by start.

    Array of ``(kind, start, end, score)`` in code points, end exclusive; a null text has
    none. A match that fails its check is dropped and not searched again.
    """
    return F.expr(f"coalesce(concat({', '.join(_spans(text, k) for k in kinds)}), array())")


def redacted(text: str, spans: str, size: int = 4096) -> Column:
    """The text with spans replaced by ``[KIND]``; overlapping spans become one, named after
    the first. Worked chunk by chunk, so a long text with many spans stays cheap; a span
    over a chunk's end has its name in the chunk where it starts."""
    chunk = f"""aggregate(
        array_sort(filter({spans}, s -> s.start < o + length(c) AND s.end > o),
                   (x, y) -> CASE WHEN x.start < y.start THEN -1 WHEN x.start > y.start THEN 1
                             WHEN x.end > y.end THEN -1 WHEN x.end < y.end THEN 1 ELSE 0 END),
        named_struct('p', o, 't', ''),
        (a, s) -> IF(s.end <= a.p, a, named_struct('p', s.end, 't', concat(a.t,
            substr(c, int(a.p - o) + 1, int(greatest(0L, s.start - a.p))),
            IF(s.start >= a.p, concat('[', upper(s.kind), ']'), '')))),
        a -> concat(a.t, substr(c, int(a.p - o) + 1)))"""
    return F.expr(f"""IF(size({spans}) = 0, {text}, array_join(transform(
        regexp_extract_all({text}, '(?s).{{1,{size}}}', 0), (c, k) -> {let_sql('o', f'k * {size}L', chunk)}), ''))""")


def find_pii(docs: DataFrame, *, text_column: str = "text", kinds: tuple[Kind, ...] = KINDS,
             least_score: float = 0.5) -> DataFrame:
    """``docs`` with a column ``pii_spans`` (lengthened where that name is taken).

    Spans below ``least_score`` are left out; with the given kinds, context only raises
    scores, so every confirmed base span stays. Null and empty texts have no spans.
    """
    (name,) = fresh(docs.columns, "pii_spans")
    spans = docs.withColumn(name, pii_spans(f"`{text_column}`", kinds))
    if min(k.score for k in kinds) < least_score:
        spans = spans.withColumn(name, F.expr(f"filter({name}, s -> s.score >= {least_score})"))
    return spans


def redact_pii(docs: DataFrame, *, text_column: str = "text", **options) -> DataFrame:
    """``docs`` with the found spans in ``text_column`` replaced by their kind."""
    found = find_pii(docs, text_column=text_column, **options)
    spans = found.columns[-1]
    return found.withColumn(text_column, redacted(f"`{text_column}`", spans)).drop(spans)
