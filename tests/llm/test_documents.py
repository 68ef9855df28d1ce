"""Fingerprints, line dedup, near duplicates, quality rules and link walks against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from furrow.llm import components, fingerprints, line_dedup, quality, simhash, url_filter


def counted(rows):
    return Counter(tuple(r) for r in rows)


# --- fingerprints


def similarity(a, b):
    a, b = Counter(a.encode().lower().split()), Counter(b.encode().lower().split())
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_samples_estimate_the_similarity():
    maker, draw, errors = fingerprints.Samples(512), random.Random(1), []
    for _ in range(40):
        a = " ".join(draw.choice("abcdefghijklmnop") * draw.randint(1, 2) for _ in range(60))
        b = fingerprints.edited(a, " ".join(draw.choice("klmnopqrst") for _ in range(60)))
        errors.append(fingerprints.likeness(maker.signature(a.encode()), maker.signature(b.encode())) - similarity(a, b))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.04


def plain_sample(maker, term, weight):
    """Order and sign of one pair, sample by sample."""
    found = []
    for seed in maker.seeds.tolist():
        x = (xxhash.xxh64_intdigest(term) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) ^ seed
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ x >> shift) * factor & (1 << 64) - 1
        r, log_c = maker.r[x % fingerprints.GRID], maker.log_c[(x >> 14) % fingerprints.GRID]
        b = np.float32(x >> 40) * np.float32(2.0**-24)
        t = np.floor(np.log(np.float32(weight)) / r + b)
        order = int(np.float32(log_c - r * (t - b + np.float32(1))).view(np.uint32))
        order = order ^ 0xFFFFFFFF if order >> 31 else order | 1 << 31
        sign = (xxhash.xxh64_intdigest(term) ^ (int(t) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)) * 0x165667B19E3779F9 & (1 << 64) - 1
        found.append(order << 32 | (sign >> 32) % 65535 + 1)
    return found


def test_samples_against_plain_numbers():
    maker = fingerprints.Samples(40)
    pairs = [(f"w{i}".encode(), 1 + i % 4 * (i % 3)) for i in range(600)]
    made = maker.evaluate([x if n == 1 else b"%b\0%d" % (x, n) for x, n in pairs])
    for i in range(0, 600, 13):
        assert made[i].tolist() == plain_sample(maker, *pairs[i])


def test_frequent_pairs_are_evaluated_once():
    """However many rare pairs pass through a full table, and signatures do not depend on it."""
    maker, asked = fingerprints.Samples(4, kept=20_000), Counter()
    evaluate = maker.evaluate
    maker.evaluate = lambda keys: (asked.update(keys), evaluate(keys))[1]
    common = [f"c{i}" for i in range(50)]
    texts = [" ".join(common + [f"r{k}x{i}" for i in range(3000)]).encode() for k in range(30)]
    made = [maker.signature(x).tolist() for x in texts]
    assert {asked[x.encode()] for x in common} == {1}
    assert made[::7] == [fingerprints.Samples(4).signature(x).tolist() for x in texts[::7]]
    for k in range(30, 200):  # the table is begun anew now and then, and never overflows
        maker.signature(" ".join(common + [f"r{k}x{i}" for i in range(3000)]).encode())
    assert len(maker.place) <= maker.kept and 2 <= asked[b"c0"] < 10


def test_neighbours(corpus, no_rows):
    docs = corpus.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()))
    made = {r["doc_id"]: r for r in fingerprints.with_neighbours(docs).collect()}
    by_text, maker = {}, fingerprints.Samples()
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
        own, changed, following = (maker.signature(x.encode()) for x in (text, edited, after))
        r = made[key]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own.tobytes().hex(), changed.tobytes().hex())
        assert (r["near_edited"], r["near_next"]) == ((own == changed).mean(), (own == following).mean())
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert len(made) == len(rows)
    assert fingerprints.with_neighbours(corpus).count() == corpus.count()
    assert fingerprints.with_neighbours(no_rows).count() == 0
    one = docs.limit(1)
    assert fingerprints.with_neighbours(one).first()["near_next"] == 1.0


# --- line dedup


def brute_lines(texts, limit):
    keys = [[line_dedup.line_key(x) for x in t.encode().split(b"\n")] for t in texts]
    docs = Counter(k for own in keys for k in set(own) if k)
    found = []
    for text, own in zip(texts, keys):
        kept = [x for x, k in zip(text.encode().split(b"\n"), own) if docs[k] < limit]
        found.append((len(own), len(own) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return Counter(found)


def test_line_dedup(corpus, no_rows):
    expected = brute_lines([r["text"] or "" for r in corpus.collect()], 10)
    for more in ({}, {"filter_bytes": 0}, {"shard_keys": 1}, {"shard_keys": 1, "filter_bytes": 20}):
        made = line_dedup.digest_columns(line_dedup.drop_lines(corpus, limit=10, carry=["doc_id"], **more)).collect()
        assert counted((r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in made) == expected
    assert any(k[1] for k in expected)
    assert line_dedup.drop_lines(no_rows).count() == 0
    assert set(line_dedup.drop_lines(corpus).first()["carried"].asDict()) == set(corpus.columns) - {"text"}


def test_documents_can_be_taken_out_again(corpus):
    half = corpus.where("doc_id < 30")
    whole = counted(line_dedup.line_refs(corpus).collect())
    start = line_dedup.line_refs(corpus.where("doc_id >= 30 OR doc_id IS NULL"))
    added = line_dedup.add_documents(start, half)
    assert counted(added.collect()) == whole
    assert counted(line_dedup.delete_documents(added, half).collect()) == counted(start.collect())


def test_cuckoo_filter():
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(6000)]
    made = line_dedup.CuckooFilter.of(keys[:3000])
    assert all(k in made for k in keys[:3000])
    rows = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
    assert made.holds(rows).tolist() == [k in made for k in keys]
    assert sum(k in made for k in keys[3000:]) < 15
    for k in keys[:1500]:
        assert made.delete(k)
    assert all(k in made for k in keys[1500:3000]) and sum(k in made for k in keys[:1500]) < 15
    tiny = line_dedup.CuckooFilter(1)
    before = [tiny.insert(k) for k in keys[:20]]
    assert before[:4] == [True] * 4 and not all(before) and all(k in tiny for k, ok in zip(keys, before) if ok)


# --- near duplicates


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(keys, distance):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in keys:
        for b in keys:
            if a < b and (a ^ b).bit_count() <= distance:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: find(k) for k in keys}


def test_near_duplicates(corpus, no_rows):
    rows = corpus.select("doc_id", "text").collect()
    prints = [brute_fingerprint(r["text"]) for r in rows]
    group = brute_groups(set(prints), 4)
    least = {}
    for r, p in zip(rows, prints):
        if r["doc_id"] is not None:
            least[group[p]] = min(least.get(group[p], r["doc_id"]), r["doc_id"])
    expected = counted((r["doc_id"], f"{p:016x}", least.get(group[p])) for r, p in zip(rows, prints))
    assert counted(simhash.near_duplicates(corpus).collect()) == expected
    kept = simhash.one_per_group(corpus)
    assert kept.columns == corpus.columns
    assert kept.count() == len({group[p] for p in prints})
    assert simhash.near_duplicates(no_rows).count() == 0 and simhash.one_per_group(no_rows).count() == 0


def test_links_find_all_groups(spark):
    """Random, clustered and chained fingerprints; several subtrees."""
    draw = random.Random(6)
    values = {draw.getrandbits(64) for _ in range(120)}
    for _ in range(4):
        centre = draw.getrandbits(64)
        for _ in range(60):
            values.add(centre ^ sum({1 << draw.randrange(64) for _ in range(draw.randint(0, 5))}))
    at = draw.getrandbits(64)
    for _ in range(30):
        values.add(at)
        for bit in draw.sample(range(64), 4):
            at ^= 1 << bit
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    frame = spark.createDataFrame(signed, "bits long").repartition(3)
    made = {r["node"]: r["root"] for r in components.components(simhash.links(frame, 4, subtree=16)).collect()}
    expected = brute_groups(values, 4)
    sizes = Counter(expected.values())
    found = {}
    for node, root in made.items():
        found.setdefault(root, set()).add(node % (1 << 64))
    brute = {}
    for node, root in expected.items():
        if sizes[root] > 1:
            brute.setdefault(root, set()).add(node)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, brute.values()))


def test_one_large_cluster_leaves_as_a_forest(spark):
    base = 0x0123456789ABCDEF
    values = {base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.links(spark.createDataFrame(signed, "bits long"), 4, subtree=64)
    # at most a tree for each of the 4 tries and the 7 subtree pairs that a fingerprint goes to
    assert links.count() < 4 * 7 * len(values) < len(values) ** 2 / 4
    assert components.components(links).select("root").distinct().count() == 1


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 900), (900, 500), (7, 7)], "a long, b long")
    made = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert made == {**{i: 0 for i in range(201)}, 500: 500, 900: 500}


# --- quality rules


def brute_statistics(text):
    words, lines = text.encode().split(), text.encode().split(b"\n")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    repeated = sum(1 for i, x in enumerate(lines) if x.split() and x in lines[:i])
    return len(words), sum(len(w.decode()) for w in words), symbols, repeated, len(covered)


def test_statistics(corpus, no_rows):
    made = quality.quality_rules(corpus, carry=["doc_id", "text"], least_rows=10)
    rows = made.collect()
    for r in rows:
        expected = brute_statistics(r["row"]["text"] or "")
        assert tuple(r[1:6]) == expected
        assert r["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (r["base_failed"] and r["kept"])
    assert len(rows) == corpus.count()
    assert quality.quality_rules(no_rows).count() == 0


def test_repeated_windows():
    draw = random.Random(2)
    for _ in range(200):
        text = " ".join(draw.choice("ab") for _ in range(draw.randint(0, 30)))
        assert quality.repeated_words(text.encode().split()) == brute_statistics(text)[4]


def test_outliers_are_found_and_prose_stays(spark):
    draw = random.Random(8)

    def prose(i):
        return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(draw.randint(60, 400)))

    rows = [(i, prose(i), "x", "s" if i % 3 else "t") for i in range(600)]
    rows += [(1000 + i, " ".join("#$%&|" for _ in range(200)) + str(i) + prose(i)[:200], "x", "s") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r["row"]["doc_id"]: r["kept"] for r in quality.quality_rules(docs, carry=["doc_id"]).collect()}
    assert all(kept[i] for i in range(600))
    assert not any(kept[1000 + i] for i in range(60))


def test_a_third_of_a_group_is_bad(spark):
    draw = random.Random(18)

    def word(low, high):
        return "".join(draw.choice("abcdefghij") for _ in range(draw.randint(low, high)))

    def prose(low=2, high=8, symbol=""):
        return " ".join(word(low, high) + symbol for _ in range(draw.randint(60, 400)))

    rows = [(i, prose(), "x", source) for i, source in enumerate(["symbols", "long", "clean"] * 200)]
    rows += [(1000 + i, prose(symbol="#"), "x", "symbols") for i in range(100)]
    rows += [(2000 + i, prose(38, 42), "x", "long") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    made = {r["row"]["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality_rules(docs, carry=["doc_id"]).collect()}
    assert not any(failed for failed, _ in made.values())
    assert [i for i, (_, kept) in made.items() if kept != (i < 1000)] == []


def test_determinant_steps_against_numpy(spark):
    """A tenth of the rows lie far away; the estimate is that of the others."""
    draw = np.random.default_rng(3)
    spread = np.array([[1.0, 0.6], [0.6, 2.0]])
    inner = draw.multivariate_normal([1, -2], spread, 4000)
    rows = [("g", x.tolist()) for x in np.concatenate([inner, draw.normal(30, 1, (400, 2))])]
    rows = quality.in_parts(spark.createDataFrame(rows, "grp string, x array<double>")).cache()
    found = quality.covariance_determinants(rows, [1e-3, 1e-3]).first()
    assert np.allclose(found["mean"], [1, -2], atol=0.12)
    assert np.allclose(np.linalg.inv(np.array(found["inverse"]).reshape(2, 2)), spread, atol=0.25)


def test_chi_square():
    assert abs(quality.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3
    assert abs(quality.chi_square(2.0, 2) - (1 - np.exp(-1))) < 1e-12


# --- url filters


def test_url_parts(spark):
    urls = {
        "http://A.Example.COM/x/Y?q#f": ("a.example.com", "/x/Y"), "no scheme": ("", ""), None: ("", ""), "": ("", ""), "a://h": ("h", ""),
        "s://h?x/y": ("h", ""), "s://h#a/b": ("h", ""), "a://b/c://d/e": ("b", "/c://d/e"), "x\n://h/p\nq": ("h", "/p\nq"),
    }
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    made = {r["page_id"]: (r["host"], r["path"]) for r in url_filter.judge(pages).collect()}
    assert [made[i] for i in range(len(urls))] == list(urls.values())


def test_rules_and_walk(spark):
    def page(i, url, *links):
        return (i, url, "".join(f'<a class=x href="{x}">l</a>' for x in links), "extra")

    rows = [
        page(0, "http://a.net/x"), page(1, "http://a.example.net/en/1"), page(2, "http://example.com/de/1"), page(3, "http://notexample.com/de/1"),
        page(4, "http://x.org/fr/1"), page(5, "http://a.net"),
        *[page(10 + i, f"http://spam.info/{i}", "http://a.net/1", "//bad.net/2") for i in range(5)],
        *[page(20 + i, f"http://fine.info/{i}", "/own", "http://x.org/fr/2") for i in range(5)],
        page(30, None), *[page(31, "http://bad.net/1")] * 22,
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    made = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert made[0] == ("net/", "block") and made[1] == ("example.net/en/", "allow") and made[2] == ("example.com/de/", "block")
    assert made[3] == (None, "allow") and made[4] == ("org/fr/", "allow") and made[5][0] is None and made[30] == (None, "allow")
    assert all(made[10 + i] == (None, "block") for i in range(5))
    assert all(made[20 + i] == (None, "allow") for i in range(5))
    assert url_filter.judge(pages).count() == len(rows)
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_walk_against_numpy(spark):
    draw = random.Random(5)
    hosts = [f"h{i}" for i in range(12)]
    edges = Counter((draw.choice(hosts), draw.choice(hosts)) for _ in range(40))
    edges = {e: n for e, n in edges.items() if e[0] != e[1]}
    start = np.array([[draw.random() for _ in range(3)] for _ in hosts])
    frame = spark.createDataFrame([(h, *map(float, s)) for h, s in zip(hosts, start)], "host string, pages double, good double, bad double")
    links = spark.createDataFrame([(*e, n) for e, n in edges.items()], "source string, target string, n long")
    made = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.walk(frame, links, 0.85, 20).collect()}
    m = np.zeros((12, 12))
    for (a, b), n in edges.items():
        m[hosts.index(a), hosts.index(b)] = n

    def spread(matrix, first):
        sums = matrix.sum(1, keepdims=True)
        p = np.where(sums > 0, matrix / np.maximum(sums, 1), np.eye(12))
        v = first
        for _ in range(20):
            v = 0.15 * first + 0.85 * v @ p
        return v

    trust = spread(m, start[:, 1]) / spread(m, start[:, 0])
    distrust = spread(m.T, start[:, 2]) / spread(m.T, start[:, 0])
    for i, h in enumerate(hosts):
        assert np.allclose(made[h], (trust[i], distrust[i]))


def test_walk_goes_on_until_it_has_settled(spark, monkeypatch):
    """A blocked host of many pages at the end of a chain of 30 others: distrust reaches all of them as far as it must."""
    size, pages = 31, np.array([1.0] * 30 + [2000.0]) / 2030
    hosts = [f"h{i}" for i in range(size)]
    bad = np.where(np.arange(size) == size - 1, pages, 0.0)
    frame = spark.createDataFrame([(h, float(p), 0.0, float(b)) for h, p, b in zip(hosts, pages, bad)], "host string, pages double, good double, bad double").coalesce(1)
    links = spark.createDataFrame([(hosts[i], hosts[i + 1], 1) for i in range(size - 1)], "source string, target string, n long").coalesce(1)
    made = {r["host"]: r["distrust"] for r in url_filter.walk(frame, links, 0.85).collect()}
    back = np.diag(np.ones(size - 1), -1)
    back[0, 0] = 1
    both = np.stack([bad, pages])
    distrust, gravity = np.linalg.solve((np.eye(size) - 0.85 * back).T, 0.15 * both.T).T
    expected = distrust / gravity
    assert np.allclose([made[h] for h in hosts], expected)
    assert expected[:10].min() > url_filter.THRESHOLD
    monkeypatch.setattr(url_filter, "most_rounds", lambda *_: 2)
    with pytest.raises(RuntimeError):
        url_filter.walk(frame, links, 0.85)


def test_one_per_group_keeps_columns_of_any_name(spark):
    rows = [(i, "the same long text " * 9 if i < 4 else f"quite another text {i} " * 9, f"own {i}", i) for i in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _mark string, other_mark int")
    docs = docs.withColumn("mark", docs["_mark"]).withColumn("_other_mark", docs["_mark"]).withColumn("bits", docs["_mark"])
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    found = {r["doc_id"]: r for r in kept.collect()}
    assert set(found) == {0, 4, 5, 6}
    assert all(r["_mark"] == r["mark"] == r["_other_mark"] == r["bits"] == f"own {i}" and r["other_mark"] == i for i, r in found.items())
