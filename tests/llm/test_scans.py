import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from rastrum.llm import decontaminate, secrets, top_k, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def contaminated(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        i = words(t)
        for k in range(max(1, len(i) - 9) if i else 0):
            x = i[k : k + 10]
            for a in range(len(w) - len(x) + 1):
                if w[a : a + len(x)] == x:
                    hit |= set(range(a, a + len(x)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(["Alpha", "beta", "γάμμα", "d9", "e"]) for _ in range(n))
    items = [(1, some(14)), (10, some(11)), (2, "Alpha beta"), (3, some(10)), (4, ""), (5, None), (6, some(12)), (6, some(30)), (7, "...")]
    docs = [(i, rng.choice([some(40), some(9) + "\n\t—" + (items[rng.choice([0, 1, 3, 7])][1]) + "!!" + some(3)])) for i in range(60)] + [(60, None), (61, ""), (62, "alpha, BETA"), (62, "alpha, BETA"), (63, some(4000))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("runs", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, *contaminated(t, items)) for i, t in docs)
    for most in (1_000_000, 7):
        assert sorted(tuple(r) for r in decontaminate.contamination(d, b, most_words=most).collect()) == want
    assert decontaminate.contamination(d, b.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.decontaminate(d.union(d.where("doc_id = 62").selectExpr("CAST(NULL AS LONG)", "text", "runs")), b)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, *r in want if not r[4]) and kept.columns == d.columns
    assert decontaminate.contamination(d.limit(0), b).count() == decontaminate.decontaminate(d.limit(0), b).count() == 0
    spans = {r.doc_id: r.spans for r in decontaminate.find_hits(d, b).collect()}
    assert [(s.start, s.end) for s in spans[62]] == [(0, 11)]


ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_of(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def test_secrets_equal_brute_force(spark):
    rng = random.Random(8)
    bits = ["token", "= ", ": ", '"', "'", "password", "API_KEY", "apikey", "ſecret", "secret=", "abc", "abcdef1", "AKIA", "ABCD1234", "0123456789abcdef", "é", "\n", "K", " ", "token=a token=secret:abcdefg"]
    texts = [None, "", 'x = "0f3a9b77c2d14e55a0b1c2d3e4f50617"\npassword = x\n', "k" * 50_000 + 'token: "hunter2hunter2"', *["".join(rng.choice(bits) for _ in range(30)) for _ in range(300)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.find_secrets(docs).collect():
        base = base_of(texts[r.doc_id] or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex")] == [r.n_assign, r.n_access, r.n_hex]
        assert set(filter(None, text.split(","))) <= set(filter(None, r.spans.split(",")))


found = lambda t: [t[a:b] for k, a, b in secrets.scan(t)[1] if k == "literal"]
L, M = "Zk39xQ7pLw2m", "tR8!kq02ZpLm"


@pytest.mark.parametrize(
    "text, want",
    [
        (f'x = "{M}"\ndb_password = x', [M]),
        (f"aws:\n  private_key: {L}\n", [L]),
        ('const authToken = "Ab3dEf" + "9hIjKl2m";', ["Ab3dEf", "9hIjKl2m"]),
        (f'colour = "{L}"', []),
        ('password = "changeme"', []),
        ("The password: please", []),
        ("password = password", []),
        ('password = "Correct horse 42 Battery"', ["Correct horse 42 Battery"]),
        (f'password = x\nx = "{L}"', [L]),  # bound further down
        (f'a = "{L}"\nb = a\nc = b\nsecret_c = c', [L]),
        (f'base = "{L}"\npassword = base + "{M}"', [L, M]),
        (f'password = decode("{L}")', [L]),
        (f'connect(host, password="{L}")', [L]),
        (f'client.set("password", "{L}")', [L]),
        (f'os.environ["DB_PASSWORD"] = "{L}"', [L]),
        (f'password: str = "{L}"', [L]),
        (f'var password string = "{L}"', [L]),
        (f'password = """{L}"""', [L]),
        ("password_" + "a" * 80 + f' = "{L}"', [L]),
        (f'def f():\n    x = "{L}"\n    return x\n\ndef g():\n    password = x\n', []),  # scopes
        (f'def f():\n    x = "{L}"\n    password = x\n', [L]),
        (f'x = "{L}"\ndef g():\n    password = x\n', [L]),
        (f'function f() {{ var x = "{L}"; }}\nfunction g() {{ var password = x; }}', []),
        (f'function f() {{ var x = "{L}"; var password = x; }}', [L]),
        (f'self.k = "{L}"\nclass A:\n  def g(self):\n    token = self.k', [L]),
        (f's = "password = {L}"', []),  # a string is no code
        (f'# password = "{L}"', [L]),
        (f"don't say the password: it isn't '{L}'", []),
        (f'if password == "{L}": pass', []),
        (f'{{"user": "bob", "api_key": "{L}"}}', [L]),
        (f"export API_TOKEN={L}\n", [L]),
        (f"PW={L}\nDB_PASSWORD=${{PW}}\n", [L]),
        (f"[db]\npassword = {L} ; comment", [L]),
        (f"<config><password>{L}</password></config>", [L]),
        (f'<add key="db_password" value="{L}"/>', [L]),
        (f"private_key: |\n  {L}{L}\n  {M}abc\nother: 1", [f"{L}{L}\n  {M}abc"]),
        (f"default: &pw {L}\npassword: *pw\n", [L]),
        (f"db = postgres://bob:{L}@host/db", [L]),
        (f'db = "postgres://bob:{L}@host/db"', [L]),
    ],
)
def test_lexing_and_propagation(text, want):
    assert found(text) == want


def test_literals_of_generated_files():
    """Sources and configurations with planted literals: exactly those that a sensitive name reaches are found."""
    rng = random.Random(21)
    letters = "abcdefghijklmnopqrstuvwxyz"
    literal = lambda: "".join(rng.choice(letters) for _ in range(5)) + "Q7" + "".join(rng.choice(letters + "XYZ0189") for _ in range(9))
    word = lambda: "".join(rng.choice(letters) for _ in range(7))
    sensitive = lambda: rng.choice(["db_password", "apiKey", "auth_token", "clientSecret", "PASSWD"])
    for _ in range(200):
        names = [sensitive() + str(k) if rng.random() < 0.4 else word() + str(k) for k in range(8)]
        values = [literal() for _ in names]
        want = {v for n, v in zip(names, values, strict=True) if secrets.name_score(n)}
        plain = [k for k, n in enumerate(names) if not secrets.name_score(n)]
        lines = {
            "env": lambda n, v: f"{n}={v}",
            "yaml": lambda n, v: f"{n}: {rng.choice([v, repr(v)])}",
            "json": lambda n, v: f'  "{n}": "{v}",',
            "xml": lambda n, v: rng.choice([f"<{n}>{v}</{n}>", f'<add key="{n}" value="{v}"/>']),
            "python": lambda n, v: rng.choice([f'{n} = "{v}"', f"{n}: str = '{v}'", f'{n} = strip("{v}")']),
            "js": lambda n, v: rng.choice([f'const {n} = "{v}";', f"let {n} = `{v}`;"]),
        }
        kind = rng.choice(list(lines))
        body = [lines[kind](n, v) for n, v in zip(names, values, strict=True)]
        if kind in ("python", "js") and plain:
            # A constant that a sensitive name is bound to, through one more name, before or after it is bound itself.
            k = rng.choice(plain)
            body[rng.randrange(len(body)) : 0] = [f"step_{k} = {names[k]}", f"my_secret = step_{k}"]
            want.add(values[k])
        text = "\n".join(body)
        assert set(found(text)) == want, text


def test_secrets_of_odd_tables(spark):
    rows = [(1, f'token = "{L}"', "x"), (1, f'token = "{L}"', "x"), (None, f'token = "{L}"', "y"), (2, None, None), (2, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("n_hex", F.lit("clash"))
    got = secrets.find_secrets(df).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_literal) for r in got) == [("1", 1, 1), ("1", 1, 1), ("2", 0, 0), ("2", 0, 0), ("None", 1, 1)]
    assert secrets.find_secrets(df.limit(0)).count() == 0


@pytest.mark.parametrize("part", ["password=(x=(", 'f("a",', "password:", "password=a+", "x=f(", "password{", "'", "a:", "://a:", "'" * 3, "/*"])
def test_lexing_takes_time_in_proportion(part):
    import time

    began = time.perf_counter()
    secrets.scan(part * 20_000 + " password")
    assert time.perf_counter() - began < 5


def test_suffixes_part_registrants(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.b.com.cn", "x.gov.uk:80", "y.z.example.com", "com", "q.p.blog.host.io", "u@m.me.de")], "host string")
    of = lambda df: {r.host: (r.domain, r.suffix) for r in df.collect()}
    assert of(url_filter.domain_columns(hosts)) == {"a.b.com.cn": ("b.com.cn", "com.cn"), "x.gov.uk:80": ("x.gov.uk", "gov.uk"), "y.z.example.com": ("example.com", "com"), "com": ("com", "com"), "q.p.blog.host.io": ("host.io", "io"), "u@m.me.de": ("m.me.de", "me.de")}
    given = of(url_filter.domain_columns(hosts, ["blog.host.io", "cn"]))
    assert given["q.p.blog.host.io"] == ("p.blog.host.io", "blog.host.io") and given["a.b.com.cn"] == ("com.cn", "cn")
    with pytest.raises(ValueError):
        url_filter.domain_columns(hosts, map(str, range(url_filter.MOST_SUFFIXES + 1)))


def test_pages_without_ids_are_judged(spark):
    pages = spark.createDataFrame([(None, "https://bad.io/a"), (None, "https://bad.io/a"), *((i, "https://bad.io/x") for i in range(30))], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0, 0) for i in range(30)] + [(None, 1, 0)] + [(100 + i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    got = url_filter.judge(pages, labels).collect()
    assert len(got) == 32 and all(r.verdict == "block" for r in got) and sum(r.page_id is None for r in got) == 2


def test_url_rules_and_reputation(spark):
    urls = [
        "https://a.example.com/en/1", "http://EXAMPLE.com/en/7x", "https://b.com/EN/", "x://n.net/de/8?q", "https://example.net/de/81#f", "ftp://q.example.net/de/9",
        "https://o.org/es/", "no scheme", None, "", "https://", "https://com/en/", "https://notcom/en/", "https://bad.host.io/a", "https://good.host2.io:80/a/b?c", "https://u@bad.host.io/x",
    ]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(100 + i, f"https://{'bad' if i < 40 else 'good'}.host{'' if i < 40 else '2'}.io/{i}") for i in range(80)], "page_id long, url string").withColumn("rule", F.lit("clash"))
    labels = spark.createDataFrame([(100 + i, int(i >= 40), 0) for i in range(80)] + [(100, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels).collect()}
    assert got[0] == ("a.example.com", "/en/1", "com/en/", "block")
    assert got[1] == ("example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2][2] is None and got[2][:2] == ("b.com", "/EN/")
    assert got[3] == ("n.net", "/de/8", "net/de/", "allow")
    assert got[4] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert got[5][2:] == ("net/de/", "allow") and got[6][2:] == ("org/es/", "block")
    assert got[7] == got[8] == got[9] == got[10] == ("", "", None, "allow")
    assert got[11][2] == "com/en/" and got[12][2] is None
    assert got[13][3] == got[15][3] == "block" and got[14][3] == "allow"
    assert url_filter.judge(pages.limit(0), labels.limit(0)).count() == 0
    assert url_filter.judge(pages, labels.limit(0)).where("rule IS NULL AND verdict = 'block'").count() == 0


@pytest.mark.parametrize("cell", [top_k.CELL, 90])
def test_top_k_equals_brute_force(spark, cell):
    rng = random.Random(2)
    import math

    vecs = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(400)]
    vecs += [(400 + i, vecs[50][1]) for i in range(60)] + [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (550, [float("inf")] * 6), (600, [0.0] * 6), (None, [1.0] * 6), (50, vecs[50][1])]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>").repartition(5).withColumn("score", F.lit("clash"))
    fine = [(i, [math.floor(x * 256) for x in v]) for i, v in vecs if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (qi, q) in enumerate(fine):
        if qi % 50 == 0:
            # Only the query's own row is no candidate: another row with its id is.
            best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for m, (i, v) in enumerate(fine) if m != n)[:5]
            want += [(qi, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert sorted(tuple(r) for r in top_k.top_k(df, cell=cell).select("query_id", "rank", "vec_id", "score").collect()) == sorted(want)


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k.top_k(df).select("query_id", "rank", "vec_id", "score").collect()] == [(0, 1, 1, 256 * 128)]
    assert top_k.top_k(df.limit(0)).count() == 0
