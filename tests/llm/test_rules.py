"""Quality rules, license scans and personal data."""

import hashlib
import random
import re

import pytest

from oracle import compare, connect
from sparselens.llm import licenses, pii, quality_rules, queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, small, name):
    problem, *_ = compare(spark, connect(small), name, queries.QUERIES[name], queries.SQL[name], small)
    assert problem is None


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked))


def test_counts(make_docs):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "é#", "\x0b", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    docs = make_docs(list(enumerate([None, "", "a a a a a a a", "x\ny\nx\n \n", *texts])))
    for r in quality_rules.quality_verdicts(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == brute_counts(r["text"])
        assert r["base_failed"] == (got[0] < 10 or 100 * got[4] > 20 * got[0]) and not (r["base_failed"] and r["kept"])


def test_limits_follow_the_source(spark):
    """A share of symbols that is usual in one source is an outlier in another."""
    rng = random.Random(1)
    text = lambda share: " ".join("##" if rng.random() < share else f"word{rng.randint(0, 10**6)}" for _ in range(200))
    rows = [(i, text(0.3 if i % 2 else 0.0), "en", "code" if i % 2 else "prose") for i in range(400)] + [(900, text(0.3), "en", "prose"), (901, text(0.3), "en", "code")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[900] and got[901] and sum(got.values()) > 395


def test_odd_rows(odd_docs, no_docs, spark):
    assert quality_rules.quality_verdicts(odd_docs).count() == odd_docs.count() and quality_rules.quality_verdicts(no_docs).count() == 0
    assert pii.personal_data_digest(odd_docs).count() == odd_docs.count() and pii.personal_data_digest(no_docs).count() == 0
    assert licenses.license_scan(odd_docs).count() == 0 and licenses.license_scan(no_docs).count() == 0


def test_license_units(make_docs):
    rows = [(1, "Prose.\nReleased under the MIT License.\nMore"), (2, "SHOUT!! RELEASED UNDER THE MIT LICENSE.!! ON!!"), (3, "released the dog under a tree"),
            (4, "Licensed under the Apache License, Version 2.0. And a sentence."), (None, "Licensed under CC BY-NC 4.0."), (5, None)]
    got = {(r["doc_id"], r["license"]) for r in licenses.license_scan(make_docs(rows)).where("dice = 1").collect()}
    assert got == {(1, "MIT"), (2, "MIT"), (4, "Apache-2.0"), (None, "CC-BY-NC-4.0")}


def best_license(unit):
    """The best template by plain sets: Dice, and the words and numbers that tell licenses apart."""
    a, told, found = set(licenses.bigrams(unit)), licenses.telling(unit)[0], []
    for k, (name, grams, words, numbers) in enumerate(licenses.template_rows()):
        dice = 2 * len(a & set(grams)) / (len(a) + len(grams))
        if a and dice >= licenses.DICE and told == words and set(numbers) <= set(licenses.words_of(unit)):
            found.append((-dice, k, name))
    return min(found)[2] if found else None


def test_pruning_loses_no_license(make_docs):
    """Every template with words taken out or added, against the best of all templates."""
    rng, rows = random.Random(6), []
    for _, texts in licenses.TEMPLATES.items():
        for t in texts:
            for _ in range(12):
                words = t.split()
                for _ in range(rng.randint(0, max(1, len(words) // 3))):
                    words.insert(rng.randint(0, len(words)), rng.choice(["foo", "the", "license", "lesser", "3"])) if rng.random() < 0.5 else words.pop(rng.randrange(len(words)))
                rows.append((len(rows), " ".join(words)))
    want = set()
    for i, t in rows:
        for unit in {t, *re.sub(r"([.!?;|%&$#*])[ \t]+", "\\1\n", t).split("\n")}:
            want |= {(i, best_license(unit))} if best_license(unit) else set()
    assert {(r["doc_id"], r["license"]) for r in licenses.license_scan(make_docs(rows)).collect()} == want


def test_every_template_names_its_own_license_only(make_docs):
    """Also shouted, in a comment block, and wrapped at any width."""
    import textwrap
    rows, want = [], set()
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            for width in (None, 30, 50, 72):
                lines = [t] if width is None else textwrap.wrap(t, width)
                for mark in ("", "// ", " * ", "# "):
                    want.add((len(rows), name))
                    rows.append((len(rows), "Some prose before it.\n\n" + "\r\n".join(mark + x for x in lines) + "\n\nAnd prose after.".upper()))
    assert {(r["doc_id"], r["license"]) for r in licenses.license_scan(make_docs(rows)).collect()} == want


def test_licenses_of_one_family_are_told_apart(make_docs):
    rows = [(1, "Licensed under the GNU General Public License, version 2"), (2, "This work, all of it, is licensed under the GNU General Public License, version 3."),
            (3, "This work is licensed under the GNU Lesser General Public License, version 3."), (4, "Licensed under CC BY-SA 4.0."), (5, "Licensed under CC BY 3.0."),
            (6, "Licensed under the Apache License, Version 1.1."), (7, "Licensed under the GNU General Public License V3.0"), (8, "Licensed under CC BY-NC-SA 4.0."),
            (9, "Licensed under the GNU Affero General Public License, version 3. Parts are licensed under the MIT License.")]
    got = {}
    for r in licenses.license_scan(make_docs(rows)).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got == {1: {"GPL-2.0"}, 2: {"GPL-3.0"}, 3: {"LGPL-3.0"}, 4: {"CC-BY-SA-4.0"}, 7: {"GPL-3.0"}, 9: {"AGPL-3.0", "MIT"}}


def test_one_license_a_planted_notice(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = {"apache license": "Apache-2.0", "mit license": "MIT", "general public license, version 3": "GPL-3.0", "cc by-nc 4.0": "CC-BY-NC-4.0"}
    want = {(r["doc_id"], name) for r in docs.collect() for notice, name in planted.items() if notice in r["text"].lower()}
    assert {(r["doc_id"], r["license"]) for r in licenses.license_scan(docs).collect()} == want and len(want) == 39


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def test_base_spans():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("ab@@..11234567890-+ ()_%x\n") for _ in range(rng.randint(0, 40)))
        assert [(s, k, e) for s, k, e, _ in pii.spans(text) if k < 4] == [x[:3] for x in brute_spans(text)]


def test_digest_of_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.personal_data_digest(docs).collect():
        want = brute_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in want).encode()).hexdigest()
        assert r["n_card"] == sum(x[3] == "card" for x in want)


def test_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB83WEST12345698765432")
    found = lambda t: [pii.KINDS[k] for _, k, _, _ in pii.spans(t)]
    assert "iban" in found("pay to GB82 WEST 1234 5698 7654 32 now") and "ssn" not in found("no 123-45-6789") and "ssn" in found("SSN 123-45-6789")
    assert found("token = " + "0a" * 20) == ["secret"] and "secret" not in found("hash " + "0a" * 20)
    assert pii.masked("write to a.b@c.de or +1 (555) 010-9999") == "write to <email> or <phone>"


def test_account_numbers_before_other_words():
    number = {"GB82WEST12345698765432": " EUR 500", "DE89 3704 0044 0532 0130 00": " BIC COBADEFF", "GB82 WEST 1234 5698 7654 32": " I paid",
              "DE89370400440532013000": " 12 May", "NO9386011117947": ", then"}
    for n, after in number.items():
        text = f"X1 {n}{after}"
        assert [(text[s:e]) for s, k, e, _ in pii.spans(text) if pii.KINDS[k] == "iban"] == [n]
    both = " ".join(number)
    assert [both[s:e] for s, k, e, _ in pii.spans(both) if pii.KINDS[k] == "iban"] == list(number)
    wrong = "AB12 3456 7890 1234 GB82 WEST 1234 5698 7654 32"
    assert [wrong[s:e] for s, k, e, _ in pii.spans(wrong) if pii.KINDS[k] == "iban"] == ["GB82 WEST 1234 5698 7654 32"]
    assert not [k for _, k, _, _ in pii.spans("GB82WEST123456987654321") if pii.KINDS[k] == "iban"]


def test_context_after_a_span():
    assert [pii.KINDS[k] for _, k, _, _ in pii.spans("078-05-1120 is my SSN")] == ["ssn"]
    assert not pii.spans("078-05-1120 " + "x " * pii.NEAR + "SSN")
    for text in ("AA00" * 100_000, "AA00 " * 100_000, "GB82 WEST 1234 5698 7654 32 " * 10_000):
        pii.spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + "(" * 200_000, "a@" * 200_000):
        pii.spans(text)
