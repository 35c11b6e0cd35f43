"""Licence scan, spelling variants and lexical search against brute force, on the small tables and on awkward rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ductlake.llm import lexical, licences, queries, spelling
from ductlake.llm.licence_texts import PHRASES, TEMPLATES

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, n long, score double, word string, labels string, `rank` int"
MIT = TEMPLATES[0][2]
ROWS = [
    (1, None, "en", 1, 0.5, "w", "l", 1), (2, "", None, None, None, None, None, None), (3, " \n\t.,", "en", 2, 1.0, "w", "l", 1),
    (4, "The MIT License. The mit\tLICENSE; general public license", "en", 3, None, "w", "l", 2), (4, "The MIT License. The mit\tLICENSE; general public license", "en", 3, None, "w", "l", 2),
    (5, "Header " + MIT.replace("to deal in", "to really deal in").replace("merge, ", "") + " trailer", "en", 4, None, "w", "l", 3), (None, "Ärger ärger Ärger ärger Permission is hereby granted", "de", 5, None, "w", "l", 4),
    (7, "licensed under the apache " * 20_000 + MIT[:400], None, 6, None, "w", "l", 5), (8, "漢字 😀 ﬁ é MIT-License 12³", "ja", 7, None, "w", "l", 6), (9, "a" * 3_000_000, "en", 8, None, "w", "l", 7),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(ROWS, DDL).repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


# Licence scan


def plain_base(text):
    words = plain_words(text)
    starts, labels = [], set()
    for _, label, phrase in PHRASES:
        wanted = phrase.split()
        for i in range(len(words) - len(wanted) + 1):
            if words[i : i + len(wanted)] == wanted:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def plain_matches(words, sequences):
    """(end, length) of the longest template strings in the text that cannot be made longer, by a set of all template strings."""
    strings = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    longest = []
    length = 0
    for end in range(1, len(words) + 1):
        length += 1
        while length and tuple(words[end - length : end]) not in strings:
            length -= 1
        longest.append(length)
    return [(i + 1, n) for i, n in enumerate(longest) if n and (i + 1 == len(longest) or longest[i + 1] != n + 1)]


def plain_chains(words, sequences):
    """By template, the best (covered, first word, first template word, end word, template end) of chains that end in each match."""
    out = []
    matches = [m for m in plain_matches(words, sequences) if m[1] >= licences.MIN_MATCH]
    for sequence in sequences:
        nodes = []
        for end, n in matches:
            ends = [e for e in range(n, len(sequence) + 1) if sequence[e - n : e] == words[end - n : end]]
            before = list(nodes)
            for t_end in ends:
                best = (n, -(end - n), -(t_end - n))
                for covered, start, t_start, c_end, c_t_end in before:
                    gain = n - max(0, c_end - (end - n), c_t_end - (t_end - n))
                    if gain > 0 and c_end < end and c_t_end < t_end and end - n - c_end <= licences.GAP and t_end - n - c_t_end <= licences.GAP:
                        best = max(best, (covered + gain, -start, -t_start))
                nodes.append((best[0], -best[1], -best[2], end, t_end))
        out.append(nodes)
    return out


@pytest.fixture(scope="module")
def small_templates():
    rng = random.Random(5)
    words = ["a", "b", "c", "d"]
    return [(f"t{i}", f"l{i % 2}", " ".join(rng.choice(words) for _ in range(12))) for i in range(4)]


def test_matching_statistics_and_chains(small_templates):
    compiled = licences.Templates([], small_templates)
    sequences = [[w.encode() for w in t.split()] for _, _, t in small_templates]
    rng = random.Random(9)
    for _ in range(60):
        words = []
        while len(words) < 60:
            s = rng.choice(sequences)
            i = rng.randrange(len(s))
            words += s[i : i + rng.randrange(1, 9)] if rng.random() < 0.8 else [rng.choice([b"a", b"x", b"c"])]
        seen, scan = [], licences.Scan(compiled)
        close = scan.close
        scan.close = lambda state, matched, end: (seen.append((end, matched)), close(state, matched, end))
        scan.feed(words[:23])
        scan.feed(words[23:])
        scan.finish()
        assert seen == [m for m in plain_matches(words, sequences) if m[1] >= licences.MIN_MATCH]
        want = max((c[0] / len(s) for s, nodes in zip(sequences, plain_chains(words, sequences)) for c in nodes), default=0.0)
        assert scan.score == pytest.approx(want)


def test_licence_query_against_brute_force(spark, documents):
    rows = {r.doc_id: r for r in queries.op11_licence_scan(spark, SF).collect()}
    texts = dict(documents.select("doc_id", "text").collect())
    assert rows.keys() == texts.keys()
    sequences = [[w.encode() for w in plain_words(t)] for _, _, t in TEMPLATES]
    strings = {tuple(s[i : i + licences.MIN_MATCH]) for s in sequences for i in range(len(s))}
    licensed = 0
    for doc_id, text in texts.items():
        r = rows[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(text)
        words = [w.encode() for w in plain_words(text)]
        near = any(tuple(words[i : i + licences.MIN_MATCH]) in strings for i in range(len(words)))
        if not near:
            assert r.labels == r.base_labels and r.score == (1.0 if r.n_base else 0.0)
        else:
            licensed += 1
            share = {label: 0.0 for _, label, _ in TEMPLATES}
            for (_, label, _), s, nodes in zip(TEMPLATES, sequences, plain_chains(words, sequences)):
                share[label] = max([share[label], *(c[0] / len(s) for c in nodes)])
            assert r.score == pytest.approx(max([1.0 if r.n_base else 0.0, *share.values()]))
            added = set(filter(None, r.labels.split(",")))
            # Labels of overlapping spans give way to the one with the larger share only.
            assert set(filter(None, r.base_labels.split(","))) <= added <= {label for label, s in share.items() if s >= licences.SHARE} | set(r.base_labels.split(","))
            best = max(share.values())
            assert best < licences.SHARE or any(share.get(label) == best for label in added)
    assert licensed


def test_licence_awkward_rows(spark, awkward):
    got = collections.defaultdict(list)
    for r in licences.licence_scan(awkward).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(ROWS)
    for row in ROWS:
        r = got[row[0]][0]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) == plain_base(row[1])
    assert got[1][0].labels == [] and got[1][0].score == 0 and got[4][0] == got[4][1]
    (span,) = got[5][0].spans
    assert span.template == "mit text" and span.label == "mit" and 0.97 < span.share < 1 and span.first_word == 1
    assert got[5][0].labels == ["mit"] and got[5][0].base_labels == []
    assert got[7][0].n_base == 0 and got[7][0].labels == []
    assert licences.licence_scan(awkward.limit(0)).count() == 0
    assert licences.licence_scan(awkward, phrases=[], templates=[]).where("score > 0 or n_base > 0").count() == 0


def test_lesser_notice_is_not_the_general_one():
    notice = next(t for n, _, t in TEMPLATES if n == "lgpl file notice")
    *_, base, labels, score, spans = licences.scan_text(notice, licences.Templates(PHRASES, TEMPLATES))
    assert base == ["gpl"] and labels == ["gpl", "lgpl"] and score == 1.0 and [s["label"] for s in spans] == ["lgpl"]


# Spelling variants


def plain_variants(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    letters = sorted({c for w in n for c in w})
    near = {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + c + w[j:] for i in range(len(w) + 1) for c in letters for j in (i, i + 1)}
        near[w] = sorted((edits & n.keys()) - {w})
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (n[w], len(near[w]), form.get(w), n.get(form.get(w)), root)
    return out


def variants(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


@pytest.mark.parametrize("limit", [spelling.GROUP, 6])
def test_spelling_against_brute_force(spark, documents, limit):
    some = documents if limit > 100 else documents.where("doc_id < 40")
    want = plain_variants(some.select("doc_id", "text").collect())
    got = variants(queries.op12_spelling_variants(spark, SF) if limit > 100 else spelling.spelling_variants(some, limit=limit))
    assert got == want and any(v[2] for v in want.values())


def test_spelling_of_made_words(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abñ") for _ in range(rng.randrange(5, 9))) for _ in range(500)} | {"aaaaa", "aaaaaa", "aaaaaaa", "x" * 700, "x" * 701, "y" + "x" * 700}
    rows = [(None, " ".join(w for w in sorted(words) for _ in range(3 + zlib.crc32(w.encode()) % 40)), "")]
    table = spark.createDataFrame(rows, "doc_id long, text string, n string")
    want = plain_variants([r[:2] for r in rows])
    for limit in (4096, 3):
        assert variants(spelling.spelling_variants(table, limit=limit)) == want
    assert any(v[4] not in (w, v[2]) and v[2] for w, v in want.items())  # a way of several forms


def test_spelling_awkward_rows(spark, awkward):
    assert variants(spelling.spelling_variants(awkward)) == plain_variants([r[:2] for r in ROWS])
    assert spelling.spelling_variants(awkward.limit(0)).count() == 0
    assert spelling.runs_of("ab" * spelling.TEXT_BLOCK + " Ab") == {"ab" * spelling.TEXT_BLOCK: 1, "ab": 1}


# Lexical search


def plain_search(rows, items, k=10):
    counts = [(doc_id, collections.Counter(plain_words(text))) for doc_id, text in rows]
    counts = [(d, c) for d, c in counts if c]
    n_all, length = len(counts), sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, terms in items.items():
        found = []
        for doc_id, c in counts:
            m = 100 - 90 + (90 * c.total() * n_all) // length
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0))
        for rank, (score, none, doc_id) in enumerate(sorted(found)[:k], 1):
            out.append((item, rank, None if none else doc_id, -score))
    return sorted(out, key=str)


def item_terms(rows):
    out = collections.defaultdict(set)
    for item, text in rows:
        if item is not None:
            out[item] |= set(plain_words(text))
    return out


def test_lexical_query_against_brute_force(spark, documents):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain_search(documents.select("doc_id", "text").collect(), item_terms(benchmark.select("item_id", "text").collect()))
    assert sorted(map(tuple, queries.op13_lexical_search(spark, SF).collect()), key=str) == want
    chunked = lexical.lexical_search(documents, benchmark, chunk_items=15)
    assert sorted(map(tuple, chunked.collect()), key=str) == want


def test_lexical_awkward_rows(spark, awkward):
    asked = [(1, "MIT license, mit LICENSE"), (2, None), (3, ""), (None, "license"), (4, "漢字 Ärger the"), (5, "nowhere"), (6, "license"), (6, "trailer"), (7, "a" * 3_000_000)]
    items = spark.createDataFrame([(*a, 1.0, 2) for a in asked], "item_id long, text string, score double, doc_id long")
    got = lexical.lexical_search(awkward, items, k=4)
    assert sorted(map(tuple, got.collect()), key=str) == plain_search([r[:2] for r in ROWS], item_terms(asked), 4)
    assert lexical.lexical_search(awkward.limit(0), items).count() == 0
    assert lexical.lexical_search(awkward, items.limit(0)).count() == 0
    assert lexical.lexical_search(awkward.where("doc_id < 4"), items).count() == 0


def test_bounds_hold_and_exclude():
    rng = random.Random(1)
    vocabulary = [b"w%d" % i for i in range(3000)]
    terms = [collections.Counter(rng.choices(vocabulary, [1 / (i + 1) for i in range(3000)], k=rng.randrange(20, 400))) for _ in range(600)]
    df = collections.Counter(t for c in terms for t in c)
    n_terms = sum(c.total() for c in terms)
    items = [(i, rng.sample(vocabulary, 12)) for i in range(20)]
    query = lexical.Query(items, {t: lexical.weight(600, df[t]) for t in df}, 600, n_terms, 5)
    block = lexical.Block(list(range(600)), terms, lexical.Hashes())
    parts = np.array([lexical.length_part(c.total(), 600, n_terms) for c in terms])
    bounds = query.bounds(block, parts)
    for (_, wanted) in query.items:
        for row in range(0, 600, 7):
            assert query.exact(terms[row], wanted, int(parts[row])) <= bounds[wanted, row].sum()
    query.rank(block)
    assert query.rescored < query.met / 10
    for bits, term in ((block.holders(t, 0), t) for t in vocabulary[::50]):
        may = np.unpackbits(bits, count=600, bitorder="little")
        assert all(may[row] for row in range(600) if term in terms[row])
