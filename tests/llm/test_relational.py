"""URL filters, line dedup, chat formatting, exact dedup and decontamination on small tables, against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from chronoplex.llm.chat import escape, format_chats, read_chats, unescape
from chronoplex.llm.decontamination import contaminated, decontaminate
from chronoplex.llm.exact_dedup import exact_dedup, kept_documents
from chronoplex.llm.line_dedup import drop_bitmaps, line_dedup
from chronoplex.llm.queries import LLM_ORACLES, LLM_QUERIES, URL_RULES
from chronoplex.llm.url_filters import filter_urls, rules_table

#: Columns whose names could clash with those that operators make.
DOCS = "doc_id long, text string, body string, words string, hash int, rule string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "b", "w", 1, "r") for i, t in rows], DOCS)


# --- urls

def brute_url(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(-len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits) if fits else None
    return host, path, best and best[1], best[2] if best else default


URLS = ["http://a.org/", "https://EXAMPLE.org/es/x", "http://x.example.org/en/1", "http://example.org/en/1/2?q#f", "http://notexample.org/es/", "http://b.com/fr/",
        "http://b.com/de/", "ftp://b.com?x/de/", "http://b.com#/de/", "http://b.org", "nothing", "", None, "http://", "a://b://c.com/de/", "http://É.ORG/\n", "http://com/de/x",
        "http://org:80/", "http://[::1]/de/", "http://a.org//"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS[:3])] + [(None, URLS[0], "x", "y")], "page_id long, url string, host string, verdict string")
    rules = rules_table(spark, [(v, h + p) for v, h, p in URL_RULES])
    got = filter_urls(pages, rules).collect()
    want = [(i, u, *brute_url(u, URL_RULES)) for i, u in enumerate(URLS + URLS[:3])] + [(None, URLS[0], *brute_url(URLS[0], URL_RULES))]
    assert sorted([tuple(r)[:6] for r in got], key=str) == sorted(want, key=str)
    assert filter_urls(pages.limit(0), rules).collect() == [] and {r.verdict for r in filter_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_rules_with_stars_quotes_and_no_token(spark):
    rules = spark.createDataFrame([("block", "a.b", "/x*/z"), ("allow", "a.b", "/x"), ("block", "q.com", "/\\E(.+)"), ("block", "", "/1"), (None, "a.b", "/")], "verdict string, host string, path string")
    pages = spark.createDataFrame(list(enumerate(["http://a.b/x1/2/z", "http://a.b/x", "http://q.com/\\E(.+)/", "http://q.com/E", "http://.a.b/1"])), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(pages, rules).collect()}
    assert got == {0: ("a.b/x*/z", "block"), 1: ("a.b/x", "allow"), 2: ("q.com/\\E(.+)", "block"), 3: (None, "allow"), 4: (None, "allow")} | {4: got[4]}


# --- lines

def brute_lines(rows, least=10):
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\f\r"))
    first, order = {}, lambda i: (i is not None, i or 0)
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(low(line), set()).add(i)
    keep = {k: min(v, key=order) for k, v in held.items() if len(k) >= least and len(v) > 1}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if low(x) not in keep or keep[low(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_corpus():
    rng = random.Random(2)
    pool = [f"This is shared line {k} É" for k in range(12)] + ["short", "", "  THIS is shared line 3 é\t", "x" * 10, "é" * 9]
    rows = [(i * 3, "\n".join(rng.choices(pool, k=rng.randint(1, 9)) + [f"own line of document {i}"] * rng.randint(0, 2))) for i in range(60)]
    rows += [(1, None), (2, ""), (None, pool[0]), (4, "\n".join(pool * 20)), (4, pool[1]), (6, "\n" * 200 + pool[2]), (6, "\n" * 200 + pool[2])]
    return rows + [(1000 + i, "A line that very many documents share\n" + str(i)) for i in range(400)]


def test_lines(spark):
    rows = line_corpus()
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(docs_of(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute_lines(rows), key=str)


def test_lines_without_frequent_ones(spark, monkeypatch):
    from chronoplex.llm import line_dedup as module
    monkeypatch.setattr(module, "HOT_SHARE", 2.0)
    rows = line_corpus()
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(docs_of(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(brute_lines(rows), key=str)
    assert line_dedup(docs_of(spark, [])).collect() == []


def test_line_bitmaps(spark):
    rows = [(1, "\n".join(f"the same line {k}" for k in range(130))), (2, "\n".join(f"the same line {k}" for k in range(129, -1, -1)) + "\nown line here")]
    got = drop_bitmaps(docs_of(spark, rows)).collect()
    assert [(r.doc, r.n_dropped, len(r.words)) for r in got] == [(2, 130, 3)]
    assert sum(bin(w & (1 << 64) - 1).count("1") for w in got[0].words) == 130


# --- chats

HARD = ["", "plain", "\\", "<|end|>\n", "<|and|>", "<\\|", "<|", "|>", "<|>", "\\<|turn:user|>", "a<", "|b", "<\\\\|", "|\\>", "\n", "é|>\\", "<|turn:", "\\### Assistant: </turn> ok"]


def test_chats_come_back(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "tool|>x", "<|end|>\n", ""]), rng.choice(HARD)) for c in range(40) for t in range(rng.randint(1, 12))]
    rows += [(50, None, None, None), (50, None, "assistant", "b"), (50, 1, "assistant", "b"), (50, 1, "assistant", "b"), (None, 1, "user", "x")]
    rng.shuffle(rows)
    turns = spark.createDataFrame([(*r, "f", "l") for r in rows], "conv_id long, turn long, role string, text string, formatted string, loss_spans string")
    got = {r.conv_id: r for r in read_chats(format_chats(turns)).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns_ in want.items():
        assert [(x.role, x.text) for x in got[c].turns] == turns_
        assert got[c].loss_text == "".join(x for r, x in turns_ if r == "assistant")
        merged = 1 + sum(a[0] != b[0] for a, b in zip(turns_, turns_[1:]))
        assert got[c].formatted.count("<|turn:") == merged
    assert format_chats(turns.limit(0)).collect() == []


def test_long_chats_come_back(spark):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["", "a\U0001f600b|>", "\U0001f600" * rng.randint(1, 3000), "<|end|>\n\\" * 200])) for t in range(700)]
    rows += [(2, t, "assistant", "") for t in range(300)] + [(3, t, "assistant", "x" * 1024) for t in range(128)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in read_chats(format_chats(turns)).collect()}
    for c in (1, 2, 3):
        mine = [(role, text) for conv, _, role, text in rows if conv == c]
        assert [(x.role, x.text) for x in got[c].turns] == mine
        assert got[c].loss_text == "".join(text for role, text in mine if role == "assistant")


def test_escape_is_reversible(spark):
    rng = random.Random(9)
    texts = HARD + ["".join(rng.choices("\\<|>a\n", k=rng.randint(0, 12))) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u and "<|" not in r.e and "|>" not in r.e for r in got)


# --- whole texts

def brute_exact(rows, largest):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        done = False
        for i in ids:
            stays = i == keep and not done
            done |= stays
            out.append((i, keep, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("parts", ["1", "7"])
def test_exact(spark, keep, parts):
    rng = random.Random(8)
    rows = [(i, rng.choice(["", None, "a", "A", "a ", "same head of the text " * 3 + str(i % 5), f"own {i}"])) for i in range(300)]
    rows += [(None, "only null"), (None, "only null"), (7000, "twice"), (7000, "twice"), (None, "a")] + [(8000 + i, "hot text") for i in range(600)] + [(9, "y" * 200_000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(r) for r in exact_dedup(docs_of(spark, rows), keep=keep).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got, key=str) == sorted(brute_exact(rows, keep == "largest"), key=str)


def test_exact_keeps_rows_with_all_columns(spark):
    docs = docs_of(spark, [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "c")])
    kept = kept_documents(docs, exact_dedup(docs))
    assert kept.columns == docs.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, "a"), (3, None), (5, "b"), (None, "c")]
    assert exact_dedup(docs.limit(0)).collect() == []


# --- benchmark

def test_contaminated(spark):
    rng = random.Random(1)
    vocabulary = [f"wort{k}" for k in range(400)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    items = {k: prose(rng.randint(14, 50)) for k in range(6)}
    rows, want = [], set()
    for i in range(80):
        words = prose(rng.choice([0, 5, 60, 300]))
        if i % 4 == 0:
            item = i // 4 % 6
            leak = list(items[item])
            for at in rng.sample(range(len(leak)), len(leak) // 12):
                leak[at] = "replaced"
            at = rng.randint(0, len(words))
            words = words[:at] + [w.upper() + rng.choice(["", ",", "."]) for w in leak] + words[at:]
            want.add((i, item))
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (None, " ".join(items[0])), (202, " ".join(items[1][:7])), (203, " ".join(items[2])), (203, "x " + " ".join(items[2]))]
    want |= {(None, 0), (203, 2)}
    bench = spark.createDataFrame([(k, " ".join(v), "t") for k, v in items.items()] + [(90, None, "t"), (91, "short one", "t")], "item_id long, text string, tokens string")
    docs = docs_of(spark, rows)
    got = contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in rows if i not in {x for x, _ in want})
    assert contaminated(docs.limit(0), bench).collect() == [] and contaminated(docs, bench.limit(0)).collect() == []


def test_contaminated_by_parts_of_items(spark):
    rng = random.Random(3)
    prose = lambda n, w: [f"{w}{rng.randrange(5000)}" for _ in range(n)]
    items = {0: prose(59, "a"), 1: prose(300, "b"), 2: prose(24, "c"), 3: prose(24, "d"), 4: prose(55, "e")}
    around = lambda words: " ".join(prose(40, "z") + words + prose(40, "z"))
    other = set(rng.sample(range(55), 14))
    quarter = ["other" if k in other else w for k, w in enumerate(items[4])]
    leaks = {
        1: (0, items[0][:29]), 2: (0, items[0][30:]), 3: (1, items[1][80:220]), 4: (4, quarter),
        5: (2, items[2][:10] + items[2][11:17] + ["other"] + items[2][18:]),  # a word left out and one replaced
        6: (3, items[3][:10] + ["put", "in"] + items[3][10:17] + ["other"] + items[3][18:]),
    }
    rows = [(i, around(words)) for i, (_, words) in leaks.items()] + [(50, around(items[0][:12])), (51, around(items[2][:11])), (52, around([]))]
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(docs_of(spark, rows), bench).collect()}
    assert got == {(1, 0): 29, (2, 0): 29, (3, 1): 140, (4, 4): got.get((4, 4)), (5, 2): 19, (6, 3): 20} and got[4, 4] >= 20


# --- registered queries

@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = LLM_QUERIES[name](spark, "/root/testdata/sf0.001")
    cursor = con.execute(LLM_ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))


@pytest.mark.parametrize("name", ["op1_url_filters", "op4_line_dedup", "op7_benchmark_decontamination", "op8_chat_formatting"])
def test_native_plans_hold_no_python(spark, name):
    plan = LLM_QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
