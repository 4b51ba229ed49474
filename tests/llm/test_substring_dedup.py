import random


import pytest

from dunlin.llm import substring_dedup as S
from tests.llm.data import AWKWARD, documents, empty, words

P = ". ".join(words(70 + k, 12) for k in range(5)) + "."  # 60 words in five sentences
Q = words(700, 60, 4000)  # 60 words without a mark
LINES = "\n".join(words(90 + k, 9) for k in range(6))
TEXTS = AWKWARD | {
    20: f"{words(71, 8)}\n{P}\n{words(72, 8)}", 21: f"{P.upper()}\n{words(73, 9)}", 22: f"x\n  {P}  \n\n{P}\nshort line",
    23: f"own words before it {P} and own words after it", 24: words(71, 8), 25: f"{words(74, 30)}\n{LINES}", 26: f"{LINES}\n{words(75, 30)}",
    27: f"{words(70, 12)}. {words(76, 12)}.", 28: "short line\nshort line", 29: f"{words(77, 30)}.\n{words(77, 30)}. Ok so. {words(77, 30)}.",
    30: f"a first text with {Q} in it", 31: f"another one\nthat has {Q.replace(' ', chr(10), 20)} too", 32: "w1 " * 300, 33: "w1 " * 150 + "end", 34: "中文没有空格\n" * 3}


def pieces(text):
    return [(m.start(), m.end(), m[0].encode().lower()) for m in S.WORD.finditer(text)]


def chunk_starts(ws):
    value = [(131 * len(w) + 31 * w[-1] + 17 * w[0] + (7 * ws[i - 1][2][-1] + 3 * ws[i - 1][2][0] if i else 0)) % 251 for i, (_, _, w) in enumerate(ws)]
    least = {min(range(i, i + S.WINDOW), key=lambda k: (value[k], -k)) for i in range(len(ws) - S.WINDOW + 1)}
    return sorted(least | {0}) if ws else []


def brute(rows):
    """{(doc_id, text): (lines, passages)}, each a set of (start, end, words)."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, out = {}, {}
    ws = [pieces(t or "") for _, t in rows]
    for k, (row, w) in enumerate(zip(rows, ws)):
        text = row[1] or ""
        lines, passages, runs = set(), set(), []
        line_of = [text.count("\n", 0, a) for a, _, _ in w]
        for n in sorted(set(line_of)):
            i = [x for x in range(len(w)) if line_of[x] == n]
            if seen.setdefault((0, tuple(w[x][2] for x in i)), (k, i[0])) != (k, i[0]):
                lines.add((w[i[0]][0], w[i[-1]][1], len(i)))
        starts = chunk_starts(w)
        for a, b in zip(starts, [*starts[1:], len(w)]):
            key = (1, tuple(x[2] for x in w[a:b]))
            first = seen.setdefault(key, (k, a))
            if first == (k, a):
                continue
            if runs and runs[-1][1] == a:
                runs[-1][1], runs[-1][3] = b, (first[0], first[1] + b - a)
            else:
                runs.append([a, b, first, (first[0], first[1] + b - a)])
        for a, b, (hk, hi), (tk, ti) in runs:
            if b - a < S.LEAST_RUN:
                continue
            left = right = 0
            while left < S.MOST and a > left and hi > left and w[a - left - 1][2] == ws[hk][hi - left - 1][2]:
                left += 1
            while right < S.MOST and b + right < len(w) and ti + right < len(ws[tk]) and w[b + right][2] == ws[tk][ti + right][2]:
                right += 1
            if b - a + left + right >= S.LEAST_PASSAGE:
                passages.add((w[a - left][0], w[b + right - 1][1], b - a + left + right))
        out[row] = (lines, passages)
    return out


def expected(rows):
    found, out = brute(rows), []
    for row in rows:
        lines, passages = found[row]
        spans = []
        for a, e, _ in sorted(lines | passages):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(e, spans[-1][1])
            else:
                spans.append([a, e])
        out.append((row[0], len(lines), sum(x[2] for x in lines), len(passages), max((x[2] for x in passages), default=0),
                    sum(e - a for a, e in spans), ",".join(f"{a}:{e}" for a, e in spans)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_report(spark):
    rows = [*TEXTS.items(), (20, TEXTS[20]), (21, TEXTS[21])]
    assert got(S.report(documents(spark, TEXTS, repeat=(20, 21)))) == expected(rows)


def test_a_line_in_fifty_documents_goes_from_all_but_the_first(spark):
    line = words(1, 18)
    texts = {k: f"{words(100 + k, 30)}\n{line}\n{words(200 + k, 30)}" for k in range(50)}
    out = {r.doc_id: r for r in S.report(documents(spark, texts)).collect()}
    assert sum(r.n_lines for r in out.values()) == 49 and out[0].n_lines == 0 and all(out[k].line_words == 18 for k in range(1, 50))


def test_glued_passages_count_in_full(spark):
    out = {r.doc_id: r for r in S.report(documents(spark, TEXTS)).collect()}
    assert out[23].longest_passage == 60 and out[31].longest_passage == 60 and out[30].longest_passage == 0
    assert TEXTS[23][slice(*map(int, out[23].spans.split(":")))] == P
    assert {21, 22, 23, 26, 31, 32, 33} <= {k for k, r in out.items() if r.longest_passage > 25} <= {21, 22, 23, 26, 29, 31, 32, 33}
    assert out[24].n_lines == 1 and out[34].n_lines == 2 and out[32].longest_passage < 300  # the first stretch stays


def test_null_and_shared_ids(spark):
    rows = [(None, f"{LINES}\nx"), (None, f"{LINES}\ny"), (3, f"{words(5, 9)}\n{LINES}"), (4, LINES), (4, f"z\n{LINES}"), (4, LINES), (0, None), (None, None), (0, LINES + "\nq")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = got(S.report(df))
    assert len(out) == len(rows)
    kept = [r for r in out if r[1] == 0 and r[0] is not None and r[0] > 0]
    assert not kept  # document 0 keeps the lines
    assert [r[1] for r in out if r[0] == 0] == [0, 0] and sorted(r[1] for r in out if r[0] is None) == [0, 6, 6]


def test_random_texts(spark):
    rnd = random.Random(8)
    pool = [words(500 + k, rnd.randrange(2, 14)) for k in range(40)]
    texts = {k: "".join(rnd.choice(pool) + rnd.choice([". ", "\n", " ", "\n\n"]) for _ in range(rnd.randrange(1, 12))) for k in range(80)}
    assert got(S.report(documents(spark, texts))) == expected([*texts.items()])


def test_cleaned_texts(spark):
    docs = documents(spark, TEXTS)
    out = {r.doc_id: r for r in S.cleaned(docs).collect()}
    assert out[21].text == f"\n{words(73, 9)}" and out[20].text == TEXTS[20] and out[1].text is None and out[20].removed_spans is None
    assert [(s.start, s.end) for s in out[21].removed_spans] == [(0, len(P))] and out[21].n_chars == len(out[21].text)
    assert out[26].text == "\n" + words(75, 30) and out[24].text == "" and out[28].text == "\n"
    assert S.cleaned(docs).columns == [*docs.columns, "removed_spans"]
    with pytest.raises(ValueError):
        S.cleaned(docs.withColumnRenamed("kinds", "removed_spans"))


def test_cleaning_leaves_nothing_to_clean(spark):
    docs = documents(spark, {k: v for k, v in TEXTS.items() if k not in (32, 33)})
    once = S.cleaned(docs)
    again = S.report(once).collect()
    assert all(r.n_lines == 0 for r in again)


def test_empty(spark):
    assert S.report(empty(spark)).count() == 0 and S.cleaned(empty(spark)).count() == 0 and S.repeated(empty(spark)).count() == 0


def test_cuts_follow_from_the_words_around():
    ws = pieces(words(3, 400, 50))
    starts = chunk_starts(ws)
    assert all(b - a <= S.MOST for a, b in zip(starts, [*starts[1:], len(ws)]))
    for at in range(0, 300, 7):  # a passage of two windows holds a whole chunk, wherever it stands
        own = chunk_starts(pieces(words(at, 11, 50) + " ") + ws[at: at + 2 * S.WINDOW])
        there = {at + k - 11 for k in own if 11 < k}
        assert len(there & set(starts)) >= 2
