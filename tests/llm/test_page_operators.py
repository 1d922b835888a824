"""Operators over pages, components and the pipeline, against plain versions."""

import base64
import hashlib
import random

import pytest
from check_oracles import connect, differences
from helpers import AWKWARD, awkward

import __spark_entry__ as contract
import corpus_pipeline
from setwright.llm import components, queries, urlrules, warc
from setwright.session import scratch_path

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(spark, connect(SF), name, SF) is None


def test_all_queries_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 11)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())


# --- components


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 130)] + [(200, k) for k in range(201, 230)] + [(5, None)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in got} == {n: root(n) for n in parent} and len(got) == len(parent)


def test_no_edges(spark):
    assert components.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


# --- WARC


def roles(rows, least=0):
    newest = {}
    for key, _, html in rows:
        if key is not None:
            newest[html or ""] = max(key, newest.get(html or "", key))
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        top = newest.get(html or "")
        revisit = len(data) >= least and top is not None and key != top
        out.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


ROWS = [(1, "a%0D\nb: c", "x"), (2, "u", "x"), (2, "u", "x"), (None, None, "x"), (5, None, None), (6, "", ""), (None, "z", "only"), (None, "z", "only"), (7, "é", "日本\r\n\r\n🙂" * 5000)]


@pytest.mark.parametrize("least", [0, 2])
def test_warc_roundtrip(spark, least):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    got = warc.warc_roundtrip(df, revisit_bytes=least, roll_bytes=300, shard_bytes=1500).collect()
    assert sorted(map(tuple, got), key=repr) == roles(ROWS, least)


def test_warc_payloads_urls_and_order(spark):
    path = scratch_path(spark, "warc-test")
    rows = [(k, f"http://h/{k}", f"page {k} " * 50) for k in range(60)]
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5), path, shard_bytes=14_000, roll_bytes=1000)
    files = manifest.orderBy("file").collect()
    assert len(files) > 4 and sum(f.records for f in files) == 60
    back = warc.read_warc(spark, path, payloads=True).collect()
    assert sorted((r.key, r.url, bytes(r.payload).decode()) for r in back) == rows
    from setwright.sinks.shared_files import open_base

    fs, base = open_base(path)
    keys = []
    for f in files:
        with fs.open_input_stream(f"{base}/{f.file}", compression=None) as stream:
            data = stream.read()
        assert hashlib.sha1(data).hexdigest() == f.sha1 and len(data) == f.bytes
        import io

        keys += [int(warc.parsed(m)[0]["X-Record-Key"]) for m in warc.members(io.BytesIO(data))]
    assert keys == sorted(keys)


def test_warc_writes_the_same_bytes_again(spark):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    runs = [
        sorted(map(tuple, warc.write_warc(df.repartition(n), scratch_path(spark, "warc-test"), shard_bytes=1500).collect())) for n in (1, 4)
    ]
    assert runs[0] == runs[1] and len({r[1] for r in runs[0]}) > 1


def test_warc_is_the_same_for_many_rows(spark):
    """Shards, files and bytes follow from the rows, not from how they are dealt or sampled."""
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(
        F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), "id").alias("url"), F.repeat(F.lit("x"), (F.col("id") * 7 % 300).cast("int")).alias("html")
    )
    runs = []
    for n in (3, 11):
        manifest = warc.write_warc(df.repartition(n, F.xxhash64("page_id", F.lit(n))), scratch_path(spark, "warc-test"), shard_bytes=1 << 20, roll_bytes=1 << 18)
        runs.append(sorted(map(tuple, manifest.collect())))
    assert runs[0] == runs[1] and sum(r[2] for r in runs[0]) == 20_000 and len({r[1] for r in runs[0]}) > 10


def test_warc_keys_of_any_text(spark):
    """Keys with line breaks and escapes, next to columns named like those used inside."""
    rows = [("a\r\nWARC-Type: x", "u%\n", "one"), ("b%0D", "v", "one"), ("b\r", "v", "two"), ("", None, ""), (None, "w", "two"), (None, "w", "two")]
    df = spark.createDataFrame([(*r, 1, 2, "z", 0) for r in rows], "page_id string, url string, html string, key int, shard int, tie string, row int")
    got = warc.warc_roundtrip(df, shard_bytes=1200).collect()
    assert sorted(map(tuple, got), key=repr) == roles(rows, 0)
    path = scratch_path(spark, "warc-test")
    warc.write_warc(df, path)
    assert sorted((r.key or "", r.url or "") for r in warc.read_warc(spark, path, "string").collect()) == sorted((k or "", u or "") for k, u, _ in rows)


def test_warc_refuses_damage():
    good = warc.record("1", "u", b"payload", None, "1970-01-01T00:00:00Z")
    assert warc.parsed(good)[1] == b"payload"
    with pytest.raises(ValueError):
        warc.parsed(good.replace(b"payload\r", b"paYload\r"))


def test_warc_empty_table(spark):
    assert warc.warc_roundtrip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# --- URL rules


def test_aliases_follow_links(spark):
    canonical = '<link rel="canonical" href="{}">'
    pages = [
        (1, "http://a.example.net/x", canonical.format("https://b.example.org/es/1")),  # alias of a blocked page
        (2, "http://c.example.net/y", '<META HTTP-EQUIV=refresh CONTENT="0; URL=http://a.example.net/x/">'),  # two steps away
        (3, "https://b.example.org/es/1", None),
        (4, "http://d.example.net/", canonical.format("http://e.example.com/fr/")),
        (5, "http://e.example.com/fr/", '<link href=http://f.example.com/de/ rel=canonical>'),  # allowed and blocked: allow wins
        (6, "http://f.example.com/de/", None),  # its own rule stands
        (7, "http://G.example.net/q", '<link rel="canonical" href="/r">'),
        (8, "http://g.example.net/r?utm_source=x#top", '<link rel=stylesheet href="http://f.example.com/de/">'),
        (9, None, canonical.format("http://f.example.com/de/")),
        (10, "no scheme", ""),
        (11, "http://www.f.example.com/de", None),  # the same page as 6
        (11, "http://www.f.example.com/de", None),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = urlrules.url_verdicts(df.withColumns({"host": df.url, "rule": df.url, "node": df.url}), queries.URL_RULES).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(pages)
    assert {k: r.verdict for k, r in by.items()} == {
        1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow"
    }
    assert (by[7].host, by[7].path, by[9].host, by[10].path) == ("g.example.net", "/q", "", "")
    assert (by[3].rule, by[5].rule, by[1].rule) == ("example.org/es/", "com/fr/", None)


def test_escaped_addresses_are_aliases(spark):
    blocked = "https://b.example.org/es/p?page=2&ref=x"
    forms = ["&amp;", "&#38;", "&#038;", "&#x26;", "&#X26;", "&"]
    pages = [(0, blocked, None), (1, "http://plain.example.net/p?page=2", '<link rel="canonical" href="https://b.example.org/es/p?page=2&amp;amp;ref=x">')]
    for k, form in enumerate(forms):
        link = blocked.replace("&", form)
        pages.append((10 + k, f"http://c{k}.example.net/", f'<link rel="canonical" href="{link}">'))
        pages.append((20 + k, f"http://r{k}.example.net/", f'<meta http-equiv="refresh" content="0; url={link}">'))
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in urlrules.url_verdicts(df, queries.URL_RULES).collect()}
    assert got == {k: "allow" if k == 1 else "block" for k in got} and len(got) == len(pages)


def test_rule_choice(spark):
    urls = ["http://x.org/a", "http://x.org", "http://xorg/", "http://a.example.org/en/12", "http://notexample.org/es/", "https://EXAMPLE.org/es/?a", "s://com/de/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "CAST(NULL AS STRING) AS html")
    got = {r.page_id: (r.rule, r.verdict) for r in urlrules.url_verdicts(df, queries.URL_RULES).collect()}
    assert got == {
        0: ("org/", "allow"), 1: (None, "allow"), 2: (None, "allow"), 3: ("example.org/en/1", "block"), 4: ("org/", "allow"),
        5: ("example.org/es/", "block"), 6: ("com/de/", "block"),
    }


def test_no_pages(spark):
    assert urlrules.url_verdicts(spark.createDataFrame([], "page_id bigint, url string, html string"), queries.URL_RULES).count() == 0


# --- pipeline


def test_pipeline_stages(spark):
    """Each stage against what its operator says of the rows it was given."""
    from helpers import components as linked
    from helpers import hits, without_repeats

    from setwright.llm import spans

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 250")
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    given = {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, "/root/testdata/sf0.01").cache()
        if name != "token_ids":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    last = {r.doc_id: r for r in docs.collect()}
    assert set(given["near_duplicates"]) <= set(given["quality"]) and len(given["near_duplicates"]) > 150
    before = {d: r.text for d, r in given["near_duplicates"].items()}
    assert set(given["repeated_passages"]) == {d for d, (_, least) in linked(before, 5, 80).items() if d == least}
    expected = without_repeats(sorted((d, r.text) for d, r in given["repeated_passages"].items()), spans.SENTENCES, spans.WORDS, spans.EDGE)
    left = {d: t for d, (_, gone, t) in expected.items() if not gone or t.strip()}
    assert {d: r.text for d, r in given["benchmark_leaks"].items()} == left
    assert all(r.n_chars == len(r.text) for r in given["benchmark_leaks"].values())
    assert set(given["token_ids"]) == {d for d, t in left.items() if not hits(t, items)[1]}
    assert set(last) == set(given["token_ids"]) and all(r.n_tokens == len(r.ids) for r in last.values())


def test_pipeline_on_awkward_rows(spark):
    docs = awkward(spark)
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = stage(spark, docs, SF)
        assert 0 < docs.count() <= len(AWKWARD), name
    assert corpus_pipeline.quality(spark, awkward(spark), SF).count() <= len(AWKWARD)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward(spark).limit(0), SF).count() == 0, name
