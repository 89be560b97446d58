"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds are email, ip, card (Luhn) and phone; their confirmed spans always stay. The method adds
iban (mod-97 over the rearranged number), ssn and secret (long hexadecimal strings): these stay
when their score reaches ``ACCEPT``. A score starts at the kind's prior, rises by ``CONFIRMED`` when a
checksum holds and by ``CONTEXT`` when one of the kind's words stands within ``NEAR`` characters before
or after the span. Offsets are code points, ends exclusive. What follows an account number may look like
more of it, so the length of its country is tried, then the longest run, and for other countries every
length that ends a word, the longest first; the search goes on after an accepted end.

Every pattern is searched in time linear in the text: emails grow from each ``@``, addresses are cut
from dotted runs of digits. Nulls: a null text is empty; a null ``doc_id`` is kept. Repeated rows give
repeated results. An empty table gives an empty result.
"""

import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from sparselens.llm.common import sliced

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
PRIOR = {"email": 0.6, "ip": 0.5, "card": 0.3, "phone": 0.5, "iban": 0.2, "ssn": 0.3, "secret": 0.3}
CONFIRMED, CONTEXT, ACCEPT, NEAR = 0.5, 0.3, 0.6, 40
WORDS = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "address", "server"), "card": ("card", "visa", "credit", "pay"),
         "phone": ("phone", "tel", "call", "mobile"), "iban": ("iban", "account", "bank", "konto"), "ssn": ("ssn", "social security"),
         "secret": ("token", "key", "secret", "password", "passwd")}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
IBAN_LEAST, WORD_END = 15, re.compile(r"\b")
#: Length of the account numbers of each country, blanks not counted.
IBAN_LENGTHS = {code: int(n) for n, codes in (x.split(":") for x in (
    "15:NO|16:BE|18:DK FI FO GL NL|19:MK SI|20:AT BA EE KZ LT LU XK|21:CH HR LI LV|22:BG BH CR DE GB GE IE ME RS VA|23:AE GI IL IQ TL|"
    "24:AD CZ ES MD PK RO SA SE SK TN VG|25:PT ST|26:IS TR|27:FR GR IT MC MR SM|28:AL AZ BY CY DO GT HU LB PL SV|29:BR EG PS QA UA|"
    "30:JO KW MU|31:MT SC|32:LC").split("|")) for code in codes.split()}
SSN = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b")
SECRET = re.compile(r"\b[0-9a-fA-F]{32,64}\b")


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban):
    """The check of account numbers: first four characters last, letters as 10 to 35."""
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def accounts(text):
    """Account numbers: at each place the country's length, else the longest run that ends a word, whose check holds."""
    m = IBAN.search(text)
    while m:
        start, usual = m.start(), IBAN_LENGTHS.get(text[m.start():m.start() + 2])
        ends = [e for e in range(m.end(), start, -1) if text[e - 1] != " " and WORD_END.match(text, e)]
        sizes = {e: e - start - text.count(" ", start, e) for e in ends}
        if usual:
            ends = [e for e in ends if sizes[e] == usual] + ends[:1]
        end = next((e for e in ends if sizes[e] >= IBAN_LEAST and mod97(text[start:e])), None)
        if end:
            yield start, end
        m = IBAN.search(text, end or start + 1)


def emails(text):
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            after = found.end()
        at = text.find("@", max(at + 1, after))


def addresses(text):
    """Four dotted numbers at a time, from the left of each dotted run."""
    for run in dotted_runs(text):
        groups = [m.span() for m in DIGITS.finditer(text, *run)]
        for i in range(0, len(groups) - 3, 4):
            four = groups[i:i + 4]
            parts = [text[s:e].lstrip("0") for s, e in four]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                yield four[0][0], four[3][1]


def dotted_runs(text):
    """Maximal runs of digits joined by single dots."""
    begin = end = None
    for m in DIGITS.finditer(text):
        if end is not None and m.start() == end + 1 and text[end] == ".":
            end = m.end()
        else:
            if begin is not None:
                yield begin, end
            begin, end = m.span()
    if begin is not None:
        yield begin, end


def proposals(text):
    """(kind, start, end, checked) of everything the patterns and checks let through."""
    for s, e in emails(text):
        yield "email", s, e, True
    if not DIGITS.search(text):
        return
    for s, e in addresses(text):
        yield "ip", s, e, True
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span(), True
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(len(d) for d in DIGITS.findall(m[0])) <= 15:
                yield "phone", *m.span(), False
    for s, e in accounts(text):
        yield "iban", s, e, True
    for m in SSN.finditer(text):
        yield "ssn", *m.span(), False
    for m in SECRET.finditer(text):
        yield "secret", *m.span(), False


def spans(text):
    """[(start, kind place, end, score)] in order; base kinds stay whatever their score."""
    out = []
    for kind, s, e, checked in proposals(text or ""):
        sides = text[max(0, s - NEAR):s].lower(), text[e:e + NEAR].lower()
        score = PRIOR[kind] + CONFIRMED * checked + CONTEXT * any(w in side for side in sides for w in WORDS[kind])
        if kind in BASE or score >= ACCEPT:
            out.append((s, KINDS.index(kind), e, min(1.0, round(score, 3))))
    return sorted(out)


def find_personal_data(docs):
    """(doc_id, found): the spans of every document as (kind, start, end, score)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in sliced(batches, 1):
            maybe = pc.fill_null(pc.match_substring_regex(batch.column(1), "[@0-9]"), False).to_pylist()
            found = [[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in spans(t.as_py())] if m else []
                     for t, m in zip(batch.column(1), maybe)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, found array<struct<kind: string, start: long, end: long, score: double>>")


def masked(text):
    """The text with every span replaced by its kind; of overlapping spans the first counts."""
    out, at = [], 0
    for s, k, e, _ in spans(text):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
            at = e
    return "".join(out) + (text or "")[at:]


def personal_data_digest(docs):
    """Counts of the base kinds, a hash of their spans, and all spans as text."""
    def run(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            lines = [[(x["kind"], f"{x['kind']}:{x['start']}:{x['end']}") for x in row] for row in rows]
            counts = [[sum(k == kind for k, _ in line) for line in lines] for kind in BASE]
            base = [hashlib.sha256(",".join(x for k, x in line if k in BASE).encode()).hexdigest() for line in lines]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()),
                 pa.array([",".join(x for _, x in line) for line in lines], pa.string())],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return find_personal_data(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
