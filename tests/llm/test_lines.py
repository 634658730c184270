from __future__ import annotations

import hashlib
import random
import re

from aerolith.llm import line_dedup, line_frequency

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(t):
    w = WORDS.findall(t or "")
    seen, dup = set(), 0
    for x in (t or "").split("\n"):
        if WORDS.search(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    marked = {p for i, g in enumerate(windows) if windows.count(g) > 1 for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(marked)


LONG = " ".join(f"word{i}" for i in range(60))
ROWS = (
    [(i, f"Shared  Footer of the site\n{LONG} {i}\n", "h") for i in range(30)]
    + [(100 + i, "\n".join(f"boiler line number {k} that every page of this host has got" for k in range(12)) + f"\nown {i}", "h") for i in range(15)]
    + [(200, None, "h"), (201, "", None), (202, "a b a b a b a b\n\n a b\n a b", None), (203, "## | x\n" * 60, "g"), (204, LONG, None), (204, LONG, None), (205, "é " * 70, "g"), (206, "tab\tand\x0bvt  " * 30, "g"), (None, LONG + " z", "g")]
    + [(300 + i, LONG + " same text", "copies") for i in range(40)]
)


def test_base_counts_and_verdicts(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, source string, kept int")
    got = line_frequency.judge(df).collect()
    assert len(got) == len(ROWS)
    want = sorted(((i, *base(t)) for i, t, _ in ROWS), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=str) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(30)) and not any(kept[100 + i] for i in range(15))  # depleted
    assert not any(kept[300 + i] for i in range(40)) and kept[204]  # each id is a document
    assert not any(r.n_boilerplate_lines for r in got if r.doc_id in (204, None))  # repeated rows are one
    text = {r.doc_id: r.text for r in line_frequency.kept_text(df).collect()}
    assert text[0] == f"{LONG} 0\n" and text[100] == "own 0"
    assert line_frequency.judge(df.limit(0)).count() == 0


def test_main_path_is_native(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    plan = line_frequency.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def pieces(t):
    """(start, end, normalised words) of the units, from the rule as the docstring has it."""
    at, sentences = 0, []
    for line in (t or "").split("\n"):
        done = True
        for m in WORDS.finditer(line):
            if done:
                sentences.append([])
            sentences[-1].append((m.start() + at, m.end() + at, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m.group())))
            done = re.search("[.!?。！？][\"')\\]’”»]*$", m.group())
        at += len(line) + 1
    joined = []
    for x in sentences:
        if joined and len(x) < 5:
            joined[-1] += x
        else:
            joined.append(list(x))
    for x in joined:
        h = [int(hashlib.md5(w[2].encode()).hexdigest()[:7], 16) for w in x]
        p = [(a * 1000003 + b) % 1073741789 for a, b in zip(h, h[1:])]
        first = 0
        for i in range(len(p)):
            if len(x) > 15 and 4 <= i < len(x) - 5 and all(p[i] < y for y in p[max(0, i - 5) : i]) and all(p[i] <= y for y in p[i + 1 : i + 6]):
                yield x[first][0], x[i][1], tuple(w[2] for w in x[first : i + 1])
                first = i + 1
        yield x[first][0], x[-1][1], tuple(w[2] for w in x[first:])


def brute_dedup(rows, floor=20):
    seen = {}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for s, _, w in pieces(t):
            seen.setdefault(w, (i, s))
    out = []
    for i, t, _ in rows:
        spans, run = [], []
        for s, e, w in [*pieces(t), (0, 0, None)]:
            if w is not None and len(w) >= 5 and seen[w] != (i, s):
                run.append((s, e, w))
            else:
                if sum(len(w) for *_, w in run) >= floor:
                    spans.append((run[0][0], run[-1][1]))
                run = []
        left = t
        for s, e in reversed(spans):
            own_line = s == 0 or t[s - 1] == "\n"
            left = left[:s] + left[e + (t[e : e + 1] == " " or (own_line and t[e : e + 1] == "\n")) :]
        out.append((i, len(spans), ",".join(f"{s}-{e}" for s, e in spans), left))
    return sorted(out, key=str)


def test_dedup_equals_brute_force(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, source string, start int")
    assert sorted(map(tuple, line_dedup.digest(line_dedup.dedup(df)).collect()), key=str) == brute_dedup(ROWS)
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_passages_inside_longer_lines(spark):
    """Passages of over 50 words are cut out of one-line texts, long ones too; a common line
    and texts of chance words stay."""
    rng = random.Random(7)
    text = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(900)}" + rng.choice(["", "", "", "", ".", "!"]) * (n > 70) for _ in range(n))
    passages = [text(60) for _ in range(6)]
    rows = [(i, f"{text(rng.choice([5, 80, 300]))} {passages[i % 6]} {text(rng.choice([3, 90]))}", "s") for i in range(60)]
    rows += [(100 + i, f"A common line of this site.\n{text(200)}", "s") for i in range(40)]
    rows += [(200, f"{text(20_000)} {passages[0]} {text(5_000)}", "s"), (201, " ".join(["and"] * 30_000), "s"), (202, " \n" * 5_000 + passages[1], "s")]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = line_dedup.dedup(df).collect()
    assert sorted(map(tuple, line_dedup.digest(line_dedup.dedup(df)).collect()), key=str) == brute_dedup(rows)
    lost = {r.doc_id for r in got if r.n_removed}
    assert lost == set(range(6, 60)) | {200, 202}
    whole = dict((r[0], r[1]) for r in rows)
    for r in got:
        if r.n_removed:
            gone = " ".join(whole[r.doc_id][x.start : x.end] for x in r.removed)
            assert len(gone.split()) >= 20 and gone in passages[0 if r.doc_id == 200 else 1 if r.doc_id == 202 else r.doc_id % 6]


def test_paragraphs_and_lines(spark):
    p = "one two three\nfour five six" + " and more" * 10
    df = spark.createDataFrame([(1, f"{p}\n\nown text"), (2, f"x\n\nOne two  three\nfour five six{' and more' * 10}\n\ny")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.dedup(df, kind="paragraph").collect()}
    whole = line_dedup.dedup(df, min_words=3, kind="line").collect()
    assert {r.doc_id: r.n_removed for r in whole} == {1: 0, 2: 1}
    assert got == {1: (0, f"{p}\n\nown text"), 2: (1, "x\n\n\ny")}
