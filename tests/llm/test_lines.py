import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import lines
from quire.llm.queries import QUERIES
from tests.llm.cases import docs_of, no_docs, odd_docs, odd_rows, words


def units(text):
    """Units as lists of words, by a plain scan: lines, sentences, and long ones cut behind the least pair of each window."""
    out = []
    for line in (text or "").encode().split(b"\n"):
        unit = []
        for word in line.split():
            unit.append(word)
            if word[-1:] in (b".", b"!", b"?"):
                out.append(unit)
                unit = []
        out.append(unit)
    cut = []
    for unit in out:
        if len(unit) <= lines.LONG:
            cut.append(unit)
            continue
        h = [word_hash(w) for w in unit]
        pair = [mixed(x * lines._ODD + y) >> 26 for x, y in zip(h, h[1:])]
        behind = set()
        for i in range(len(pair) - lines.CUT_WINDOW + 1):
            window = range(i, i + lines.CUT_WINDOW)
            behind.add(max(j for j in window if pair[j] == min(pair[k] for k in window)))
        edges = [0, *(j + 1 for j in sorted(behind)), len(unit)]
        cut += [unit[x:y] for x, y in zip(edges, edges[1:])]
    return [u for u in cut if u]


def word_hash(word):
    return int(lines.hashed_words(word)[0])


def mixed(x):
    x %= 2**64
    x ^= x >> 31
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    return x ^ (x >> 29)


def poly(values):
    acc, power = 0, 1
    for v in values:
        acc, power = (acc + v * power) % 2**64, power * lines._ODD % 2**64
    return mixed(acc)


def grams(parts):
    """(the gram's words, first word) of each stretch's least gram, by looking at every gram of every stretch."""
    n = len(parts)
    hashes = [poly([word_hash(w) for w in p]) for p in parts]
    begin = [sum(map(len, parts[:i])) for i in range(n)]

    def end(i, size):
        total, j = 0, i
        while j < n and total < size:
            total += len(parts[j])
            j += 1
        return j if total >= size else None

    value = {i: (poly(hashes[i : end(i, lines.GRAM_WORDS)]) >> 26, end(i, lines.GRAM_WORDS)) for i in range(n) if end(i, lines.GRAM_WORDS)}
    picked = set()
    for i in range(n):
        e = end(i, lines.STRETCH_WORDS)
        if e is None:
            break
        inside = [j for j in range(i, e) if j in value and value[j][1] <= e]
        least = min(value[j][0] for j in inside)
        picked.add(max(j for j in inside if value[j][0] == least))
    return [(tuple(tuple(u) for u in parts[p : value[p][1]]), begin[p]) for p in sorted(picked)]


def brute(docs):
    """Texts after deletion, with dictionaries of the units themselves and matches word by word."""
    split = {d: (t or "").encode().split() for d, t in docs.items()}
    prints = {d: grams(units(t)) for d, t in docs.items()}
    first = {}
    for d in sorted(docs):
        for g, p in prints[d]:
            first.setdefault(g, (d, p))
    out = {}
    for d, text in docs.items():
        gone = set()
        for g, p in prints[d]:
            other, q = first[g]
            if (other, q) == (d, p):
                continue
            a, b, s, e = split[d], split[other], 0, 0
            while p - s > 0 and q - s > 0 and a[p - s - 1] == b[q - s - 1]:
                s += 1
            while p + e < len(a) and q + e < len(b) and a[p + e] == b[q + e]:
                e += 1
            if s + e >= lines.LEAST_WORDS:
                gone.update(range(p - s, p + e))
        if not gone:
            out[d] = text
            continue
        kept, k = [], 0
        for line in text.split("\n"):
            pieces = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+", line)
            left = [x for i, x in enumerate(pieces, k) if i not in gone]
            if len(left) == len(pieces):
                kept.append(line)
            elif "".join(left):
                kept.append("".join(left).strip(" \t\r\x0b\x0c"))
            k += len(pieces)
        out[d] = "\n".join(kept)
    return out


def test_query_against_dictionaries(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op5_winnowed_lines"](spark, small).collect()
    expected = brute(docs)
    assert {r["doc_id"]: r["text"] for r in rows} == expected
    count = lambda t: len((t or "").encode().split())
    assert all(r["deleted_words"] == count(docs[r["doc_id"]]) - count(r["text"]) for r in rows)
    assert any(r["deleted_words"] for r in rows)


def test_passages_over_fifty_words_go_wherever_they_stand(spark):
    rng = random.Random(4)
    sentence = lambda n: words(rng, n, 100_000).capitalize() + "."
    passage = " ".join(sentence(9) for _ in range(6)) + "\n" + sentence(8)
    texts = []
    for i in range(12):
        own = [sentence(12) for _ in range(8)]
        spot = i % 9
        texts.append("\n".join(own[:spot]) + ("\n" if i % 2 else " ") + passage + ("\n" if i % 3 else " ") + "\n".join(own[spot:]))
    rows = {r["doc_id"]: r for r in lines.dedup_lines(docs_of(spark, texts)).collect()}
    assert rows[0]["deleted_words"] == 0 and rows[0]["text"] == texts[0]
    for i in range(1, 12):
        assert rows[i]["deleted_words"] == 62, i
        own = " ".join(texts[i].split()).replace(" ".join(passage.split()), " ")
        assert rows[i]["text"].split() == own.split()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 6), st.integers(1, 30)), max_size=20), min_size=1, max_size=5))
def test_least_grams_are_those_of_every_stretch(shapes):
    texts = ["\n".join(" ".join(f"u{k}{i % 3}" for i in range(n)) for k, n in shape) for shape in shapes]
    made = lines.Units([t.encode() for t in texts])
    _, at = made.fingerprints()
    expected, before = [], 0
    for t in texts:
        expected += [before + p for _, p in grams(units(t))]
        before += len(t.split())
    assert made.start[at].tolist() == expected


def test_odd_rows(spark):
    rows = odd_rows()
    out = lines.dedup_lines(odd_docs(spark).drop("extra")).collect()
    assert len(out) == len(rows)
    # Rows that repeat whole are one document, so none of them loses anything.
    assert {r["deleted_words"] for r in out if r["doc_id"] == 7} == {0}
    again = next(r for r in out if r["doc_id"] == 8)
    assert again["deleted_words"] > 0 and re.fullmatch(r"(a b c d e\n)*(a b c d e)?\n?", again["text"])
    assert [r["text"] for r in out if r["doc_id"] == 0] == [None] and [r["text"] for r in out if r["doc_id"] == 2] == [" \n\t "]
    assert lines.dedup_lines(no_docs(spark)).count() == 0


def test_a_copy_keeps_an_empty_text(spark):
    text = words(random.Random(5), 120, 5000)
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(spark, [text, text, text + "\n\nnew end"])).collect()}
    assert out == {0: text, 1: "", 2: "\nnew end"}


def test_passages_that_start_and_end_inside_sentences_go(spark):
    rng = random.Random(6)
    source = words(rng, 300, 100_000).split()  # one sentence without an end
    texts, own = [" ".join(source)], []
    for i, n in enumerate((50, 51, 60, 75, 90, 120)):
        before, after = words(rng, 7 + i, 100_000), words(rng, 9 + i, 100_000)
        texts.append(f"{before} {' '.join(source[20 * i : 20 * i + n])} {after}.")
        own.append((n, f"{before} {after}."))
    rows = {r["doc_id"]: r for r in lines.dedup_lines(docs_of(spark, texts)).collect()}
    assert rows[0]["text"] == texts[0]
    assert [(rows[i + 1]["deleted_words"], rows[i + 1]["text"]) for i in range(len(own))] == own


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab.!\u00e9\x0b\x85 \n\t", max_size=60))
def test_words_and_their_hashes(text):
    raw = text.encode()
    hashes = lines.hashed_words(raw)
    found = raw.split()
    assert len(hashes) == len(found)
    for h, w in zip(hashes.tolist(), found):
        assert h == word_hash(w) and bool(h & 1) == w.endswith((b".", b"!", b"?"))
    assert len(set(hashes.tolist())) == len(set(found))


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32), st.integers(50, 80), st.booleans())
def test_shared_runs_share_a_fingerprint(seed, n, sentences):
    rng = random.Random(seed)

    def prose(k):
        return [w + ("." if sentences and rng.random() < 0.12 else "") for w in words(rng, k, 50_000).split()] if k else []

    passage = prose(n)
    sides = [prose(rng.randrange(40)) + passage + prose(rng.randrange(40)) for _ in range(2)]
    found = []
    for side in sides:
        grams_, at = (made := lines.Units([" ".join(side).encode()])).fingerprints()
        found.append(dict(zip(grams_.tolist(), made.start[at].tolist())))
    assert set(found[0]) & set(found[1])
