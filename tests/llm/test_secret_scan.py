import hashlib
import re

from dunlin.llm import secret_scan
from tests.llm.data import AWKWARD, documents, empty, words

# the contract's patterns, letters of the names in either case, ASCII alone
NAME = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({NAME})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
HEX = "0123456789abcdef" * 2
TEXTS = AWKWARD | {
    10: f'PassWord = "hunter22" token:abc secret: {HEX}', 11: "AKIA" + "A1" * 8 + " AKIAshort", 12: f"é{HEX}g{HEX[:23]} {HEX[:24]}",
    13: "toKen: tOken=abcdefg", 14: "ſecret=abcdefgh api_key='x-y_z.0' APIKEY: QQQQQQ", 15: f'PassWord = "hunter22" token:abc secret: {HEX}',
    16: words(9, 50) + " passwd=" + "z" * 5000, 17: "password=abcde", 18: f"api_key={HEX}{HEX}"}


def brute(t):
    t = t or ""
    s = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    s += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    s += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    said = [x[2] for x in sorted(s)]
    return (*(sum(x.startswith(k) for x in said) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(said).encode()).hexdigest())


def test_base_spans(spark):
    got = secret_scan.digests(secret_scan.scan(documents(spark, TEXTS, repeat=(10, 1)))).collect()
    assert len(got) == len(TEXTS) + 2
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got} == {i: brute(t) for i, t in TEXTS.items()}
    by = {r.doc_id: r.spans for r in got}
    assert by[10] == by[15] != "" and by[17] == ""


def test_ledger_scans_each_pair_once(spark, scratch):
    ledger = f"{scratch}/ledger"
    secret_scan.scan(documents(spark, {10: TEXTS[10], 11: TEXTS[11], 15: TEXTS[15]}), ledger).collect()
    first = spark.read.parquet(ledger)
    assert first.select("blob").distinct().count() == 2 and first.count() == 2 * len(secret_scan.RULES)
    got = secret_scan.scan(documents(spark, TEXTS), ledger)
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.digests(got).collect()} == {i: brute(t) for i, t in TEXTS.items()}
    again = spark.read.parquet(ledger)
    blobs = {hashlib.sha256((t or "").encode()).digest() for t in TEXTS.values()}
    assert again.count() == again.select("blob", "kind", "version").distinct().count() == len(blobs) * len(secret_scan.RULES)
    newer = dict(secret_scan.RULES, hex=(2, r"[0-9a-f]+", 0, 30))
    secret_scan.scan(documents(spark, TEXTS), ledger, newer).collect()
    assert spark.read.parquet(ledger).count() == len(blobs) * (len(secret_scan.RULES) + 1)


def test_redaction(spark):
    docs = documents(spark, TEXTS)
    out = secret_scan.redact(docs, secret_scan.scan(docs))
    r = {x.doc_id: x for x in out.collect()}
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    assert r[10].text == '[SECRET]" token:abc [SECRET]' and r[10].n_chars == len(r[10].text)
    assert r[17].text == TEXTS[17] and r[1].text is None and r[18].text == "[SECRET]" and r[7].text == TEXTS[7]
    assert r[12].text == f"é[SECRET]g{HEX[:23]} [SECRET]"


def test_empty(spark):
    assert secret_scan.digests(secret_scan.scan(empty(spark))).count() == 0


def test_redaction_takes_the_body_of_a_private_key(spark):
    body = "\n".join("MIIEvQ" + "aB3+/9xZ" * 7 for _ in range(5))
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    docs = documents(spark, {1: f"see {head}\n{body}\nQUJD\n{end} and more", 2: f"see {head}\n{body}\nQUI=\nClean words follow here.",
                             3: f"a {head}\\n{body.replace(chr(10), chr(92) + 'n')}\\n{end}", 4: f"{head} is a header line"})
    out = {r.doc_id: r.text for r in secret_scan.redact(docs, secret_scan.scan(docs, rules=secret_scan.WHOLE_RULES)).collect()}
    assert out == {1: "see [SECRET] and more", 2: "see [SECRET]\nClean words follow here.", 3: "a [SECRET]", 4: "[SECRET] is a header line"}


def test_redaction_by_row(spark):
    df = spark.createDataFrame([(None, f"x {HEX}", 9), (None, "clean words alone, thirty of them or so", 9), (5, HEX, 9), (5, "clean words alone, thirty of them or so", 9)],
                               "doc_id long, text string, n_chars int")
    out = [(r.doc_id, r.text) for r in secret_scan.redact(df, secret_scan.scan(df)).collect()]
    assert sorted(out, key=str) == sorted([(None, "x [SECRET]"), (None, df.collect()[1].text), (5, "[SECRET]"), (5, df.collect()[1].text)], key=str)
