from __future__ import annotations

import datetime
import random
import re

import pytest

from aerolith.llm import pseudonyms as P

MOVE = P.Permutation(b"key").apply


def test_permutation_is_one_and_can_be_undone():
    p = P.Permutation(b"k")
    for n in (1, 2, 3, 10, 97, 1000):
        assert sorted(p.apply(i, n, "x") for i in range(n)) == list(range(n))
    for n in (10**15, 2**32, 73049):
        for x in (0, 1, n // 3, n - 1):
            assert p.undo(p.apply(x, n, "x"), n, "x") == x
    assert P.Permutation(b"other").apply(5, 10**9, "x") != p.apply(5, 10**9, "x")


@pytest.mark.parametrize(
    ("value", "kind"),
    [("4111 1111 1111 1111", "card"), ("4111111111111111", "card"), ("+1 (017) 555-7713", "phone"), ("(212) 555-1234", "phone"), ("123-45-6789", "ssn"), ("97.51.17.173", "ipv4"), ("1990-02-28", "date"), ("28.02.1990", "date"), ("02/28/1990", "date"), ("DE89 3704 0044 0532 0130 00", "iban"), ("DE89370400440532013000", "iban"), ("jo.doe42@mail.example.com", "email")],
)
def test_formats_hold(value, kind):
    new, found = P.pseudonymised(f"see {value}, ok", MOVE)
    assert [(f[0], f[1], f[2]) for f in found] == [(4, 4 + len(value), kind)]
    made = new[4 : -len(", ok")]
    assert made != value
    if kind not in ("ipv4",):
        assert re.sub(r"[0-9]", "0", re.sub("[a-z]", "a", made)) == re.sub(r"[0-9]", "0", re.sub("[a-z]", "a", value))
    again, found2 = P.pseudonymised(f"x {made} y", MOVE)
    assert [f[2] for f in found2] == [kind]  # a pseudonym is as valid as the value


@pytest.mark.parametrize("value", ["GB29 NWBK 6016 1331 9268 19", "NL91 ABNA 0417 1643 00", "IE29 AIBK 9311 5212 3456 78", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"])
def test_ibans_with_a_bank_code_of_letters(value):
    for form in (value, value.replace(" ", "")):
        new, found = P.pseudonymised(f"to {form}, and 4111 1111 1111 1111", MOVE)
        assert [f[2] for f in found] == ["iban", "card"]
        assert found[0][:2] == (3, 3 + len(form)) and form not in new


def test_linked_across_forms_and_validated():
    new, _ = P.pseudonymised("4111 1111 1111 1111 / 4111111111111111 / 1990-02-28 / 28.02.1990", MOVE)
    a, b, c, d = new.split(" / ")
    assert a.replace(" ", "") == b
    assert datetime.date.fromisoformat(c) == datetime.datetime.strptime(d, "%d.%m.%Y").date()
    for t in ("4111111111111112", "1990-02-30", "999.1.1.1", "000-12-3456", "DE00370400440532013000", "1234567", "v1.2.3.4.5", "a@b"):
        assert P.pseudonymised(t, MOVE) == (t, [])


def test_secrets_and_neighbours():
    t = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" password=a9ce335683f9 a=b 9807915762804490 1219538112535716\n+1 (243) 555-5526 233.254.104.120'
    new, found = P.pseudonymised(t, MOVE)
    assert [f[2] for f in found].count("secret") == 2 and {"phone", "ipv4"} <= {f[2] for f in found}
    for s, e, _ in found:
        assert t[s:e] not in new
    assert re.fullmatch(r"[0-9a-f]{40}", new.split('"')[1])
    assert P.pseudonymised(t, P.Permutation(b"other").apply)[0] != new


def test_long_windows_lose_nothing():
    card = "4808200777490071"
    for n in range(0, 90):
        t = "1.2.3.4 " + "w" * n + " " + card + " end"
        assert any(t[s:e] == card for s, e, _ in P.pseudonymised(t, MOVE)[1]), n


def test_tables(spark):
    rows = [(1, "mail a.b@c.org", 99, "x"), (2, None, None, "x"), (3, "", 0, "x"), (None, "call +1 (017) 555-7713", 5, "x"), (1, "mail a.b@c.org", 99, "x"), (4, "9" * 50_000, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, found string")
    got = P.pseudonymise(df, b"k").collect()
    assert len(got) == 6 and sorted(r.n_found for r in got) == [0, 0, 0, 1, 1, 1]
    assert len({r.text for r in got if r.doc_id == 1}) == 1
    out = P.replace(df, b"k")
    assert out.columns == df.columns and out.count() == 6
    assert {r.n_chars for r in out.where("doc_id = 1").collect()} == {14}
    assert {r.n_chars for r in out.where("doc_id = 4").collect()} == {1}
    assert P.pseudonymise(df.limit(0), b"k").count() == 0


@pytest.mark.parametrize("forms", [("+447911123456", "+44 7911 123456", "+44-7911-123456"), ("+4915112345679", "+49 1511 2345679"), ("+12125551234", "+1 (212) 555-1234"), ("+35312345678", "+353 1 234 5678")])
def test_one_phone_number_has_one_pseudonym(forms):
    made = []
    for form in forms:
        new, found = P.pseudonymised(f"call {form} now", MOVE)
        assert [f[:3] for f in found] == [(5, 5 + len(form), "phone")]
        made.append("".join(c for c in new if c.isdigit()))
    code = forms[1][1:].split()[0]
    assert len(set(made)) == 1 and made[0].startswith(code) and made[0] != "".join(c for c in forms[0] if c.isdigit())


def test_grouped_american_express():
    new, found = P.pseudonymised("card 3782 822463 10005.", MOVE)
    assert found == [(5, 22, "card")] and P._luhn(P._digits(new)[:-1]) == int(new[-2])


def test_long_names_are_no_limit():
    local = "a.b" * 40 + "c"
    new, found = P.pseudonymised(f"to {local}@mail.example.com", MOVE)
    assert found == [(3, 3 + len(local) + 17, "email")] and local[:20] not in new
    t = "password" + " " * 100 + "=" + " " * 100 + "a9ce335683f9"
    assert [f[2] for f in P.pseudonymised(t, MOVE)[1]] == ["secret"]


def plain_finder(t):
    """Every value by trying each form at each place of the whole text, without windows."""
    found, at = [], 0
    while at < len(t):
        tried = ((re.compile(form).match(t, at), kind, make) for kind, form, make in P._NUMBERS)
        m, kind, make = next(((m, kind, make) for m, kind, make in tried if m), (None, None, None))
        valid = m and make(m.group(), lambda x, n, what: x) is not None
        if valid:
            found.append((at, -m.end(), 0, kind))
        at = m.end() if valid else at + 1
    found += [(m.start(), -m.end(), 99, "email") for m in re.finditer(r"[A-Za-z0-9_%+-](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", t)]
    named = r"(?:token|password|passwd|secret|api[_-]?key|access[_-]?key)[\"']?\s*[=:]\s*[\"']?([A-Za-z0-9_+/~.-]{6,}[A-Za-z0-9_+/~=-])"
    found += [(m.start(1), -m.end(1), 98, "secret") for m in re.finditer(named, t, re.I)]
    out, at = [], 0
    for s, e, _, kind in sorted(found):
        if s >= at:
            out.append((s, -e, kind))
            at = -e
    return out


def test_finds_what_a_plain_finder_finds():
    rng = random.Random(4)
    values = ["4111 1111 1111 1111", "4111111111111111", "3782 822463 10005", "+1 (017) 555-7713", "+447911123456", "(212) 555-1234", "123-45-6789", "97.51.17.173", "1990-02-28", "02/28/1990", "GB29 NWBK 6016 1331 9268 19", "DE89370400440532013000", "jo.doe42@mail.example.com", "api_key: 'a9ce335683f9'", "1990-02-30", "4111111111111112", "2024", "v1.2.3.4.5", "THE NUMBER", "word", "- 7", "x=1", "99 88 77"]
    seen = 0
    for _ in range(400):
        t = "".join(rng.choice(values) + rng.choice([" ", " ", "\n", ", ", " word " * 20, "; "]) for _ in range(rng.randint(1, 30)))
        want = plain_finder(t)
        assert P.pseudonymised(t, MOVE)[1] == want
        seen += len(want)
    assert seen > 2000


def test_the_key_is_the_sessions(spark):
    assert P.key_of(spark) == P.EXAMPLE_KEY
    spark.conf.set(P.KEY_SETTING, "mine")
    try:
        assert P.key_of(spark) == b"mine"
    finally:
        spark.conf.unset(P.KEY_SETTING)
