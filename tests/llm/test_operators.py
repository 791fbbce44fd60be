"""Each operator against a brute-force version, and on awkward tables."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import extract, fingerprint, language, neardup, pack, pieces, quality, queries, rollup, shard, toxicity
from folioflow.llm.common import byte_bpe, vocabulary, words_of
from folioflow.shipping import ship

BPE = "byte_bpe_50k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, length string, label string"


@pytest.fixture(scope="module")
def frame(spark):
    ship(spark)

    def make(texts, langs=None):
        rows = [(i, t, (langs or ["en"] * len(texts))[i], "s", 0, 1, "x", "y") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="module")
def awkward(spark, frame):
    """Nulls, empty and very long texts, repeated rows and extra columns whose names clash."""
    rows = frame([None, "", " \n\t", "word", "one two three four five six seven", "a b c d e f " * 20_000, "x" * 30_000, "ünï ⟨中⟩ 🤗 é | & <b>"])
    more = spark.createDataFrame([(None, "a null id", None, None, None, None, None, None), (4, "one two three four five six seven", "en", "s", 0, 1, "x", "y")], SCHEMA)
    return rows.unionByName(more).cache()


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0).cache()


def syllables(seed, stems, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(stems) for _ in range(r.randint(1, 3))) for _ in range(n))


EN, DE, FR = "the th and er on in re ed".split(), "der sch ung ein ich heit ü".split(), "le que é eau ment tion ou".split()


# --- packing ---------------------------------------------------------------------------------------------------------------


def test_encoder_gives_the_library_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(BPE))
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|>", "<|endoftext|", "", "a  b\n\n c's 12 don't\t", "naïve 中文 🤗<|endoftext|>", "x" * 500, syllables(1, FR, 300), " \n x\r\n  "]
    assert [byte_bpe(vocabulary(BPE))(x) for x in texts] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def check_packing(docs, placed, capacity=1024):
    rows, by_sequence = placed.collect(), defaultdict(list)
    encode = byte_bpe(vocabulary(BPE))
    want = Counter()
    for d in docs.collect():
        ids = [*encode(d.text or ""), 2]
        first = len(ids) % capacity or min(len(ids), capacity)
        for k, (a, b) in enumerate([(0, first), *((at, at + capacity) for at in range(first, len(ids), capacity))]):
            want[(d.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= capacity
    return len(by_sequence), -(-sum(r.length for r in rows) // capacity)


def test_packing(awkward, empty, frame):
    check_packing(awkward, pack.pack(awkward, vocabulary(BPE)))
    assert pack.pack(empty, vocabulary(BPE)).count() == 0
    docs = frame([syllables(i, EN, random.Random(i).randint(1, 700)) for i in range(300)])
    used, least = check_packing(docs, pack.pack(docs, vocabulary(BPE)))
    assert used <= least + 2
    # Blocks that repeat, with a hot length.
    docs = frame([syllables(i % 5, EN, 40 + i % 7 * 31) for i in range(300)])
    used, least = check_packing(docs, pack.pack(docs, vocabulary(BPE), block_items=40))
    assert used <= least * 1.05 + 3


def test_sum_of_squares_choice():
    bins, at, n = pack.sum_of_squares(np.array([6, 6, 4, 3, 1]), 10)
    assert n == 2 and at.tolist() == [0, 0, 6, 6, 9]  # 4 fills a bin, 3 then opens gap 1, which 1 fills
    spans, slots, total = pack.plan({5: 1000, 3: 10}, 10, 64)
    assert total == 500 + 4 and sum(s[3] * s[4] for s in spans) == 1010 and sum(len(x[2]) for x in slots) == sum(s[4] for s in spans)


def test_plans_are_small_at_any_size():
    for n in (10**6, 10**10):
        histogram = {s: n // 1023 for s in range(1, 1024)}
        spans, slots, total = pack.plan(histogram)
        tokens = sum(s * c for s, c in histogram.items())
        assert sum(len(x[2]) for x in slots) < 6 * pack.BLOCK_ITEMS and total * 1024 < 1.001 * tokens + 1024
        placed = Counter()
        for s, _, _, copies, per_copy, _, _ in spans:
            placed[s] += copies * per_copy
        assert placed == histogram


def test_sequences_hold_the_tokens(frame):
    docs = frame(["hello world", "a b c"])
    got = pack.sequences(docs, pack.pack(docs, vocabulary(BPE)), vocabulary(BPE)).collect()
    encode = byte_bpe(vocabulary(BPE))
    assert sorted(sum((r.ids for r in got), [])) == sorted([*encode("hello world"), 2, *encode("a b c"), 2])


# --- pieces ----------------------------------------------------------------------------------------------------------------


def test_viterbi_is_the_best_segmentation():
    p = pieces.loaded(vocabulary("piece_bpe_32k.model"))
    scores = {p.pieces[i]: s for i, s in p.scores.items()}
    for text in ("Hello  world\nthe é中", "aaa bbb", "🤗 x", " lead", syllables(3, DE, 30)):
        marked = p.normalize(text)
        best = [0.0] + [-float("inf")] * len(marked)
        for end in range(1, len(marked) + 1):
            best[end] = max([best[end - 1] + p.unknown_score] + [best[a] + scores[marked[a:end]] for a in range(max(0, end - 30), end) if marked[a:end] in scores])
        ids, score = p.encode(text)
        assert score == pytest.approx(best[-1]) and p.decode(ids) == text
        assert p.viterbi(marked)[1] == pytest.approx(score)


def test_space_marks_of_the_text_come_back():
    p = pieces.loaded(vocabulary("piece_bpe_32k.model"))
    for text in ("▁", "▁▁a", "a▁b", " ▁ ", "x ▁\n▁y▁", "a  b", "  "):
        assert p.decode(p.encode(text)[0]) == text
    assert len(p.encode("a▁b")[0]) == len(p.encode("a")[0]) + 3 + len(p.viterbi("b")[0])


def test_pieces_columns(awkward, empty):
    model = vocabulary("piece_bpe_32k.model")
    encoded = pieces.encode(awkward, model)
    rows = encoded.collect()
    assert len(rows) == 10 and all(r.n_tokens == len(r.ids) for r in rows) and {r.n_tokens for r in rows if r.doc_id in (0, 1)} == {0}
    texts = {r.doc_id: r.text for r in pieces.decode(encoded, model).collect()}
    assert all(texts[r.doc_id] == (r.text or "") for r in awkward.collect())
    assert pieces.digest(awkward, model).where("round_trip").count() == 10 and pieces.digest(empty, model).count() == 0


# --- language --------------------------------------------------------------------------------------------------------------


def test_language(frame, awkward, empty):
    texts = [syllables(i, (EN, DE, FR)[i % 3], 60) for i in range(150)]
    docs = frame([*texts, None, "123 !?"], [("en", "de", "fr")[i % 3] for i in range(150)] + ["en", None])
    rows = {r.doc_id: r for r in language.identify(docs).collect()}
    assert sum(rows[i].lang_pred == ("en", "de", "fr")[i % 3] for i in range(150)) >= 147
    assert rows[150].lang_pred == rows[151].lang_pred == "und" and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert language.identify(empty).count() == 0 and language.identify(awkward).count() == 10
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_codewords():
    assert language.codewords(1).shape[0] == 1 and language.codewords(4).shape == (4, 7)
    code = language.codewords(9).astype(int)
    assert min(((a != b).sum() for i, a in enumerate(code) for b in code[:i])) >= 5


# --- quality ---------------------------------------------------------------------------------------------------------------


def kneser_ney_by_hand(words, order):
    """Probabilities of all n-grams of one language by the textbook."""
    top = Counter()
    for w, n in words.items():
        s = quality.START * (order - 1) + w + quality.END
        for i in range(len(s) - order + 1):
            top[s[i : i + order]] += n
    levels = {order: top}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter()
        for g in levels[n + 1]:
            levels[n][g[1:]] += 1
    below, out = None, {}
    for n in range(1, order + 1):
        counts = levels[n]
        of = Counter(counts.values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] + of[2] else None
        d = {}
        for k in (1, 2, 3):
            raw = k - (k + 1) * y * of[k + 1] / of[k] if y is not None and of[k] else 0.5 + 0.25 * k
            d[k] = min(max(raw, 0.05), k - 0.05)
        total, kinds = Counter(), defaultdict(Counter)
        for g, c in counts.items():
            total[g[:-1]] += c
            kinds[g[:-1]][min(c, 3)] += 1
        here = {}
        for g, c in counts.items():
            h = g[:-1]
            back = sum(d[k] * kinds[h][k] for k in (1, 2, 3)) / total[h]
            here[g] = (c - d[min(c, 3)]) / total[h] + back * (1 / (len(counts) + 1) if n == 1 else below[g[1:]])
        below = out[n] = here
    return out


def test_model_is_kneser_ney(spark, frame):
    text = syllables(5, EN, 200)
    docs = frame([text, None, ""])
    words = Counter(text.split())
    by_hand = kneser_ney_by_hand(words, 3)
    probabilities, _ = quality.kneser_ney(quality.ngram_counts(docs, 3), 3)
    got = {(r.order, r.gram): np.exp(r.value) for r in probabilities.collect()}
    assert got.keys() == {(n, g) for n, x in by_hand.items() for g in x}
    assert all(got[n, g] == pytest.approx(p) for n, x in by_hand.items() for g, p in x.items())
    model = quality.fit(docs, 3)
    w = text.split()[0]
    s = quality.START * 2 + w + quality.END
    assert model.words("en", [w])[0] == pytest.approx(sum(np.log(by_hand[3][s[i : i + 3]]) for i in range(len(w) + 1)), rel=1e-5)
    assert (model.words("en", ["zzz", "", "日本"]) < 0).all() and np.isfinite(model.words("xx", ["a"])).all()


def by_hand(text):
    words, lines = words_of(text), [x for x in (text or "").split("\n") if words_of(x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def test_quality(frame, awkward, empty):
    junk = [" ".join(w + "%%%" for w in syllables(900 + i, EN, 200).split()) for i in range(3)]
    docs = frame([syllables(i, EN, 120 + i) + "\nsame line\nsame line" for i in range(80)] + junk + ["the the the and " * 50])
    for table in (docs, awkward):
        texts = defaultdict(list)
        for r in table.collect():
            texts[r.doc_id].append(r.text)
        for r in quality.rate(table).collect():
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in [by_hand(t) for t in texts[r.doc_id]]
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    kept = {r.doc_id for r in quality.rate(docs).where("kept").collect()}
    assert kept == set(range(80))
    assert quality.rate(empty).count() == 0 and quality.passing(docs).columns == docs.columns and quality.passing(docs).count() == 80


def test_all_ngrams_price_words(frame):
    texts = [syllables(i, EN, 60) for i in range(40)] + ["ǆo ǆe " + syllables(90 + i, FR, 60) for i in range(4)]
    docs = frame(texts, ["en"] * 40 + ["xx"] * 4)
    few, all_ = ({r.doc_id: r for r in quality.rate(docs, kept=n).collect()} for n in (20, quality.KEPT))
    alone = {r.doc_id: r for r in quality.rate(docs.where("lang = 'xx'"), kept=0).collect()}
    for i, r in all_.items():
        assert few[i].perplexity == pytest.approx(r.perplexity) and few[i].kept == r.kept
        assert i < 40 or alone[i].perplexity == pytest.approx(r.perplexity)


def units_by_hand(words):
    """Words between spaces, and two characters on both sides of each space."""
    marked = [quality.START, *words, quality.END] if words else []
    return [f" {w} " for w in words] + [f"{a[-2:]:>2} {b[:2]:<2}" for a, b in zip(marked, marked[1:], strict=False)]


def test_units_are_those_by_hand(spark):
    r = random.Random(4)
    texts = ["", None, " ", "a", "\ta\x0bbc \x0c\r\n", "zero\0 \0 x\0", "é 中 🤗🤗🤗 ab\u3000cd \x1c\x85 e", "same same same same", "x" * 70_000]
    texts += ["".join(r.choice("ab é中🤗 \n") for _ in range(r.randrange(60))) for _ in range(300)]
    u = quality.units_of(quality.pa.array(texts, quality.pa.string()))
    got = defaultdict(list)
    for owner, i in zip(u.word_owners.tolist(), u.word_ids.tolist(), strict=True):
        got[owner].append(f" {u.words[i].as_py()} ")
    for owner, i in zip(u.joint_owners.tolist(), u.joint_ids.tolist(), strict=True):
        got[owner].append(u.joints[i].as_py())
    repeats = quality.repeated_words(u, len(texts))
    for i, text in enumerate(texts):
        assert Counter(got[i]) == Counter(units_by_hand(words_of(text))) and repeats[i] == by_hand(text)[4]
    symbols, _ = quality.marks(quality.pa.array([*texts, "#*$%&|<>é|"], quality.pa.string()).slice(1))
    assert symbols.tolist() == [sum((t or "").count(c) for c in "#*$%&|<>") for t in texts[1:]] + [9]
    none = quality.units_of(quality.pa.array([], quality.pa.string()))
    assert len(none.word_ids) == len(none.joint_ids) == 0


def test_counts_are_those_by_hand(frame):
    texts, langs = [syllables(i, (EN, FR)[i % 2], 30) for i in range(60)] + [None, ""], ["en", "fr"] * 30 + [None, "en"]
    want = Counter()
    for text, lang in zip(texts, langs, strict=True):
        for unit in units_by_hand(words_of(text)):
            want.update((lang or "und", unit[i : i + 4]) for i in range(len(unit) - 3))
    got = {(r.lang, r.gram): r.n for r in quality.text_ngram_counts(frame(texts, langs)).collect()}
    assert got == want


def test_ngrams_cross_words(frame):
    words = "a bcd e\n f".split()
    grams = lambda s: [s[i : i + 4] for i in range(len(s) - 3)]
    units = units_by_hand(words)
    assert sorted(g for u in units for g in grams(u)) == sorted(grams(f" {quality.START} a bcd e f {quality.END} "))
    phrases = ["of the old house", "in a small town", "when rain began", "they had to leave", "by early morning"]
    r = random.Random(3)
    texts = [" ".join(r.choice(phrases) for _ in range(60)) for _ in range(30)]
    mixed = [" ".join(r.sample(t.split(), len(t.split()))) for t in texts[:2]] + [" | ".join(t.split()) for t in texts[2:4]]
    rows = {x.doc_id: x.perplexity for x in quality.rate(frame(texts + mixed)).collect()}
    assert min(rows[i] for i in (30, 31)) > 1.2 * max(rows[i] for i in range(30))


def test_band_is_of_distinct_texts(frame):
    texts = [syllables(i, EN, 120 + i) for i in range(30)] + [syllables(99, EN, 450)] * 50
    kept = {r.doc_id for r in quality.rate(frame(texts)).where("kept").collect()}
    assert kept == set(range(80))
    rows = [r.asDict() for r in quality.rate(frame([syllables(1, EN, 120)] * 3)).collect()]
    assert all(r["upper"] / r["lower"] > 1.5 for r in rows)


def test_rows_without_id_have_verdicts_of_their_own(frame):
    docs = frame([syllables(i, EN, 120) for i in range(20)] + ["the the the and " * 50]).withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r.text for r in quality.passing(docs).collect()) == sorted(syllables(i, EN, 120) for i in range(20))


# --- toxicity --------------------------------------------------------------------------------------------------------------


def test_toxicity(spark, frame, awkward, empty):
    r = random.Random(1)
    texts, labels = [], []
    for i in range(900):
        words, toxic = syllables(i, EN, 80).split(), i % 6 == 0
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), r.choice(["idiot", "zorkel" + r.choice(EN), "you m0ron"]))
        texts.append(" ".join(words))
        labels.append((i, int(toxic)))
    docs, marks = frame(texts), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    rows = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    held = [i for i in rows if rows[i].held_out]
    assert np.mean([rows[i].predicted == labels[i][1] for i in held]) >= 0.97 and all(x.predicted == int(x.score >= 0.3) and 0 <= x.score <= 1 for x in rows.values())
    clean = {x.doc_id for x in toxicity.without_toxic(docs, model).collect()}
    assert clean == {i for i in rows if rows[i].score < 0.3} and toxicity.without_toxic(docs, model).columns == docs.columns
    assert toxicity.score(awkward, model).count() == 10 and toxicity.score(empty, model).count() == 0
    nothing = toxicity.fit(empty, marks.limit(0))
    assert {x.score for x in toxicity.score(awkward, nothing).collect()} == {0.0}


def test_isotonic_rises():
    raw = np.array([0.1, 0.2, 0.2, 0.3, 0.4, 0.5])
    at, to = toxicity.isotonic(raw, np.array([0, 1, 0, 0, 1, 1.0]))
    assert (np.diff(to) >= 0).all() and (np.diff(at) >= 0).all() and 0 <= to.min() <= to.max() <= 1


# --- main text ---------------------------------------------------------------------------------------------------------------


def test_extraction(spark):
    ship(spark)
    long = "This is a long paragraph of an article, which goes on for a while so that it counts as text. " * 2
    page = f"""<html><head><title>no</title><style>p{{}}</style></head><body><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>
      <div id=sidebar><p>{long}</p></div><article><h1>A &amp; B</h1><p>{long}<p>Short.</p><ul><li>one<li>two</ul><form>Mail <input></form><script>if (a < b) "</p>"</script>
      <p>Last&nbsp;<b>one</b><br>here</p></article><div class="comments"><p>{long}</p></div><footer>&copy; x</footer></body></html>"""
    want = "\n\n".join(["A & B", long.strip(), "Short.", "one", "two", "Last one here"])
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (4, "w", "<p"), (5, "x", "plain &lt;text&gt;"), (6, "y", "<div><p>a</p>" * 3000), (1, "u", page)]
    pages = spark.createDataFrame([(*r, "text") for r in rows], "page_id long, url string, html string, text string")
    got = extract.extract(pages).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 7 and by[1].text == want and by[1].n_chars == len(want) and by[2].text == by[None].text == by[4].text == "" and by[5].text == "plain <text>" and by[6].text.count("a") == 3000
    assert extract.extract(pages.limit(0)).count() == 0


def stretches_by_hand(weights, window=3):
    """Lines are cut where a whole window of them is empty; parts in which no window surges go."""
    padded = [0] * (window - 1) + weights + [0] * (window - 1)
    sums = [sum(padded[i : i + window]) for i in range(len(padded) - window + 1)]
    some = [x for x in sums if x]
    level = min(extract.SURGE_CHARS, extract.SURGE_SHARE * sum(some) / len(some)) if some else 0
    out, at = [], [i for i, w in enumerate(weights) if w]
    while at:
        k = next((k for k in range(1, len(at)) if at[k] - at[k - 1] > window), len(at))
        part, at = at[:k], at[k:]
        if max(sums[part[0] : part[-1] + window]) >= level:
            out.append((part[0], part[-1]))
    return out


def test_stretches_are_those_by_hand():
    assert extract.stretches([0, 0, 0, 5, 300, 0, 250, 5, 0, 0, 0, 5, 0]) == [(3, 7)]  # from dive to dive; the last 5 has no surge
    r = random.Random(6)
    for _ in range(400):
        weights = [r.choice([0, 0, 0, r.randrange(1, 30), r.randrange(400)]) for _ in range(r.randrange(30))]
        assert extract.stretches(weights) == stretches_by_hand(weights)


def test_windows_decide(spark, monkeypatch):
    """Without the surge and the dive, other text comes out: on whole pages, and where only links tell a menu."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    right = [extract.main_text(h) for h in pages]
    long = "A paragraph of the article that goes on for long enough to count as text by itself, as it has many words. " * 2
    links = "".join(f"<p><a href=/{i}>Some other page {i} of this site</a></p>" for i in range(6))
    plain = f"<body><div>{links}</div><div><h1><a href=x>Title</a></h1><p>{long}</p><p>Short.</p><p>{long}</p><p><a href=y>Source</a></p></div><div>{links}</div></body>"
    assert extract.main_text(plain).split("\n\n") == ["Title", long.strip(), "Short.", long.strip(), "Source"]
    wrong = {"first": lambda w: [(0, 0)], "last": lambda w: [(len(w) - 1,) * 2], "longest": lambda w: [(w.index(max(w)),) * 2]}
    for name, choice in wrong.items():
        monkeypatch.setattr(extract, "stretches", choice)
        assert np.mean([extract.main_text(h) != x for h, x in zip(pages, right, strict=True)]) > 0.5, name
    monkeypatch.setattr(extract, "stretches", lambda w: [(0, len(w) - 1)])
    assert extract.main_text(plain).count("Some other page") == 12


def test_broken_pages_take_linear_time():
    import time

    for part in ("<div>x", '<a "', "</b><i>", "<td>", "<p></p>", '<a ">" ', "<a x='", "<li>a<div>", "<!-", "<script>", "<a href=x>y"):
        began = time.time()
        extract.main_text(part * (10**6 // len(part)))
        assert time.time() - began < 5, part
    deep = extract.main_text("<div>" * 50_000 + "words of a text " * 20)
    assert deep == ("words of a text " * 20).strip()


def test_article_text_is_kept_whole():
    long = "A paragraph of the article that goes on for long enough to count as text by itself, as it has many words. " * 2
    parts = ['<section id="discussion">', '<section id="related-work">', '<h2 id="copyright">', '<p class="legal">', '<div class="search-methods">']
    page = "<body><article>" + "".join(f"{p}{i} {long}</{p[1:].split()[0]}>" for i, p in enumerate(parts)) + '<div class="comments">no</div></article></body>'
    got = extract.main_text(page)
    assert all(f"{i} {long.strip()}" in got for i in range(5)) and not got.endswith("no")
    short = "".join(f"<p>short {i}</p>" for i in range(8))
    flat = extract.main_text(f"<body><h1>Title</h1><p>first {long}</p>{short}<h2>On</h2><p>second {long}</p><p>End.</p></body>")
    assert flat.startswith("Title") and "first" in flat and "short 5" in flat and "second" in flat and flat.endswith("End.")


# --- fingerprints ------------------------------------------------------------------------------------------------------------


def test_fingerprints(frame, awkward, empty):
    import hashlib

    texts = [syllables(i // 2 if i < 10 else i, EN + FR, 60 + i % 9) if i >= 10 else syllables(i // 2, EN, 80) for i in range(120)]
    docs = frame(texts)
    for table in (docs, awkward.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = {r.doc_id: r for r in fingerprint.fingerprinted(table).collect()}
        order = sorted(((r.doc_id, r.text or "") for r in table.collect()), reverse=True)
        for k, (d, t) in enumerate(order):
            after = order[(k + 1) % len(order)][1]
            half = len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            assert rows[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[d].n_chars == len(t)
            assert rows[d].near_next == 1.0 if t == after else 0 <= rows[d].near_next <= 1.0
    rows = {r.doc_id: r for r in fingerprint.fingerprinted(docs).collect()}
    assert all(rows[2 * i].fingerprint == rows[2 * i + 1].fingerprint for i in range(5))
    assert np.mean([r.near_edited for r in rows.values()]) > np.mean([r.near_next for r in rows.values()]) + 0.05
    assert fingerprint.fingerprinted(awkward).count() == 10 and fingerprint.fingerprinted(empty).count() == 0 and fingerprint.fingerprinted(docs.limit(1)).count() == 1


def test_small_ranges_meet(frame):
    docs = frame([str(i) for i in range(50)])
    whole = fingerprint.neighbours(docs, 50).where("guest").count()
    parts = fingerprint.neighbours(docs, 7)
    assert whole == 1 and parts.where("not guest").count() == 50 and parts.where("guest").count() == parts.select("range").distinct().count() > 3


def test_frequencies_and_band(frame):
    docs = frame(["a b", "a c", "a a", None])
    assert {r.term: r.n for r in fingerprint.document_frequencies(docs).collect()} == {"a": 3, "b": 1, "c": 1}
    assert len(fingerprint.lexicon(docs, 1.0, 0.5)) == 1


def test_copies_count_once_and_thin_texts_are_told_whole(frame):
    docs = frame(["a b"] * 5 + ["a c", "d c"])
    assert {r.term: r.n for r in fingerprint.document_frequencies(docs).collect()} == {"a": 2, "b": 1, "c": 2, "d": 1}
    band = np.sort(np.array([fingerprint.xxhash.xxh64_intdigest(t) for t in (b"w1", *(b"z%d" % i for i in range(9)))], np.uint64))
    table = fingerprint.Terms(band)
    base = {b"w%d" % i for i in range(2, 90)}
    one, near, other = table.mark(base), table.mark(base | {b"w1"}), table.mark({b"w1", b"q"})
    assert fingerprint.nearness(one, near) > 0.5 and fingerprint.nearness(near, other) < 0.5
    full = table.mark(base | {b"z%d" % i for i in range(9)})
    assert not full.thin and fingerprint.nearness(one, full) > 0.4


# --- near duplicates -----------------------------------------------------------------------------------------------------------


def components_by_hand(rows, words):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def edited(text, r, times):
    words = text.split()
    for _ in range(times):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(frame, words):
    r = random.Random(words)
    base = syllables(1, EN, 150)
    # Edits of one text, which are linked through others only, beside copies, short texts and strangers.
    texts = [edited(base, r, r.randint(0, 10)) for _ in range(40)] + [syllables(50 + i, EN, r.randint(1, 120)) for i in range(40)]
    texts += [texts[3], texts[50].upper(), "Of.", "of.", "a b c", "A  b\nc", "", None] + [edited(syllables(99, DE, 30), r, i % 3) for i in range(12)]
    r.shuffle(texts)
    docs = frame(texts)
    want = components_by_hand(list(enumerate(texts)), words)
    got = {x.doc_id: x for x in neardup.grouped(docs, words=words).collect()}
    assert {d: (x.n_shingles, x.component_id) for d, x in got.items()} == want and all(x.kept == (d == x.component_id) for d, x in got.items())
    assert {x.doc_id for x in neardup.first_of_group(docs, words=words).collect()} == {d for d, (_, c) in want.items() if d == c}


def test_near_duplicates_awkward(awkward, empty):
    rows = neardup.grouped(awkward, words=2).collect()
    assert len(rows) == 10 and all(x.component_id == x.doc_id and x.kept for x in rows)
    first = neardup.first_of_group(awkward)
    assert first.count() == 9 and first.columns == awkward.columns and neardup.grouped(empty).count() == 0


def test_large_groups_make_few_pairs(frame, monkeypatch):
    """Texts with two edits each of one base, which none of them is: candidates must not grow with the group's square."""
    counts = {}
    possible = neardup._possible
    monkeypatch.setattr(neardup, "_possible", lambda rows, similarity: (counts.update(last=(out := possible(rows, similarity)).count()), out)[1])
    for words, edits in ((5, 2), (2, 4)):
        pairs = []
        for n in (100, 400):
            r = random.Random(n)
            base = syllables(7, EN, 60)
            texts = [edited(base, r, edits) for _ in range(n)]
            want = components_by_hand(list(enumerate(texts)), words)
            got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.grouped(frame(texts), words=words).collect()}
            assert got == want
            pairs.append(counts["last"])
        assert pairs[1] <= 8 * max(pairs[0], 100) and pairs[1] < 400 * 399 / 2 / 20


def test_subgroups_and_outliers(frame):
    """Groups within a group, a centre that is far from most, and members of very different length."""
    r = random.Random(8)
    base = syllables(7, EN, 200)
    second = edited(base, r, 9)
    texts = [edited(base, r, r.randint(0, 6)) for _ in range(60)] + [edited(second, r, r.randint(0, 6)) for _ in range(60)]
    texts += [" ".join(base.split()[:k]) for k in range(100, 200, 9)] + [base + " " + syllables(80 + i, DE, 10 * i) for i in range(12)]
    r.shuffle(texts)
    for words in (2, 5):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in neardup.grouped(frame(texts), words=words).collect()}
        assert got == components_by_hand(list(enumerate(texts)), words)


def test_long_texts_are_read_in_parts(monkeypatch):
    text = " ".join(f"w{i % 70_001} x{i % 9}" for i in range(60_000))
    whole = neardup.shingles(text, 5, neardup.Words())
    signature = neardup.super_minhash([whole[:3000]], 240)
    monkeypatch.setattr(neardup, "PART", 1000)
    assert (neardup.shingles(text, 5, neardup.Words()) == whole).all()
    monkeypatch.setattr(neardup, "ELEMENTS", 700)
    assert (neardup.super_minhash([whole[:3000]], 240) == signature).all()


def test_super_minhash_estimates():
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 400).astype(np.uint64))
    b = np.concatenate([a[:300], np.unique(r.integers(0, 2**63, 100).astype(np.uint64))])
    s = neardup.super_minhash([a, b, a[:1], a], 240)
    assert (s[0] == s[3]).all() and abs((s[0] == s[1]).mean() - 0.6) < 0.12 and np.isfinite(s).all() and s.max() < 240


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60) if i % 20 != 19] + [(r.randrange(100, 130), 100) for _ in range(40)]
    got = {x.node: x.label for x in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == i // 20 * 20 for i in range(60)) and {v for k, v in got.items() if k >= 100} == {100}


# --- sharding ------------------------------------------------------------------------------------------------------------------


def test_sharding(frame, awkward, empty):
    docs = frame(["same"] * 500 + [f"t{i}" for i in range(703)]).drop("rank")
    rows = shard.shard_rows(docs, bucket_records=100).collect()
    by = defaultdict(list)
    for x in rows:
        by[x.shard].append(x.slot)
    assert sorted(x.doc_id for x in rows) == list(range(1203)) and set(by) == set(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = shard.shard_rows(docs, bucket_records=100).collect()
    assert {x.doc_id: (x.shard, x.slot) for x in rows} == {x.doc_id: (x.shard, x.slot) for x in again}
    first = [x.doc_id for x in sorted(rows, key=lambda x: (x.shard, x.slot))]
    assert np.corrcoef(first, range(1203))[0, 1] < 0.2 and {x.doc_id: x.shard for x in shard.shard_rows(docs, seed=3, bucket_records=100).collect()} != {x.doc_id: x.shard for x in rows}
    assert shard.shard_rows(awkward).count() == 10 and shard.shard_rows(empty).count() == 0


def test_order_is_of_seed_and_records_alone(frame, spark, tmp_path):
    docs = frame(["same"] * 300 + [f"t{i}" for i in range(700)]).drop("doc_id")  # 300 records are wholly equal
    docs.write.parquet(f"{tmp_path}/d")
    found = []
    for parts, order in ((1, "text"), (7, "rank"), (3, "n_chars")):
        rows = shard.shard_rows(spark.read.parquet(f"{tmp_path}/d").repartition(parts, F.rand(parts)).sortWithinPartitions(order), bucket_records=100).collect()
        found.append(sorted((r.text, r.shard, r.slot) for r in rows))
    assert found[0] == found[1] == found[2] and max(Counter(s for t, s, _ in found[0] if t == "same").values()) < 80


def test_shards_are_written(frame, tmp_path, spark):
    shard.write_shards(shard.shard_rows(frame([str(i) for i in range(40)])), f"file://{tmp_path}/out")
    assert len(list((tmp_path / "out").glob("shard=*"))) == 8 and spark.read.parquet(f"file://{tmp_path}/out").count() == 40


def test_documents_are_sharded_whole(frame, tmp_path, spark, monkeypatch):
    texts = ["long " * (i % 7) * 400 + str(i) for i in range(200)]
    frame(texts).write.parquet(f"{tmp_path}/documents.parquet")
    written = []
    write = shard.write_shards
    monkeypatch.setattr(shard, "write_shards", lambda df, path: (written.append(path), write(df, path)))
    rows = queries.op9_shard(spark, str(tmp_path)).collect()
    files = {r.doc_id: (r.text, r.shard, r.slot) for r in spark.read.parquet(written[0]).collect()}
    assert {r.doc_id: (r.size, r.text_crc32, r.shard, r.slot) for r in rows} == {d: (len(t) + 1, zlib.crc32(t.encode()), s, k) for d, (t, s, k) in files.items()}
    assert [files[i][0] for i in range(200)] == texts
    sizes = shard.shuffled(frame(["x" * 10_000] * 100), bucket_bytes=50_000)[0]
    assert sizes.select(F.spark_partition_id().alias("p")).distinct().count() > 5


# --- token counts ----------------------------------------------------------------------------------------------------------------


def test_rollup(spark, tmp_path):
    schema = rollup.CHANGES
    kept = rollup.Rollup(spark, f"file://{tmp_path}/r")
    assert kept.totals().count() == 0
    one = spark.createDataFrame([("insert", "a", "en", "v", 10, None), ("insert", "a", None, "v", 4, None), ("insert", None, "en", "v", None, None)], schema)
    two = spark.createDataFrame([("revise", "a", "en", "v", 7, 10), ("delete", "a", None, "v", 4, None)], schema)
    assert kept.commit("one", one) and not kept.commit("one", one) and kept.commit("two", two) and not kept.commit("two", one)
    assert {(r.source, r.lang): (r.documents, r.tokens) for r in kept.totals().collect()} == {("a", "en"): (1, 7), ("und", "en"): (1, 0)}
    with pytest.raises(Exception, match="unknown change"):
        kept.commit("bad", spark.createDataFrame([("drop", "a", "en", "v", 1, None)], schema))
    assert not kept.committed("bad") and kept.totals().count() == 2
    with pytest.raises(ValueError):
        kept.commit("../x", one)


def test_totals_are_merged_and_batches_count_once(spark, tmp_path):
    kept = rollup.Rollup(spark, f"file://{tmp_path}/m", merge_after=3)
    want = Counter()
    for i in range(11):
        changes = spark.createDataFrame([("insert", f"s{i % 2}", "en", "v", i, None)], rollup.CHANGES)
        assert kept.commit(f"b{i}", changes) and not kept.commit(f"b{i // 2}", changes)
        want[f"s{i % 2}"] += i
        assert {r.source: r.tokens for r in kept.totals().collect()} == dict(want) | ({} if i else {"s0": 0})
    newest, _, held, later = kept._state()
    assert newest == 3 and len(held) == 9 and len(later) == 2 and len(kept._marks("commits")) == 5
    # Two writers of one batch, and of one merge: one of each counts.
    changes = spark.createDataFrame([("insert", "s0", "en", "v", 5, None)], rollup.CHANGES)
    for folder in ("z1", "a2"):
        rollup.deltas(changes).write.parquet(f"file://{tmp_path}/m/rows/{folder}")
    assert kept._mark("commits", "late", "z1") and kept._mark("commits", "late", "a2") and not kept._mark("commits", "late", "z3")
    assert {r.source: r.tokens for r in kept.totals().collect()} == {"s0": want["s0"] + 5, "s1": want["s1"]}
    # Rows without a mark, as a lost writer leaves them, have no effect.
    rollup.deltas(changes).write.parquet(f"file://{tmp_path}/m/rows/lost")
    assert kept.totals().agg(F.sum("tokens")).first()[0] == sum(want.values()) + 5


def test_rollup_history(spark, frame, tmp_path):
    docs = frame([syllables(i, EN, 5 + i) for i in range(25)] + [None, ""])
    kept = rollup.Rollup(spark, f"file://{tmp_path}/h")
    for batch, changes in rollup.history(docs, vocabulary(BPE)):
        assert kept.commit(batch, changes) and not kept.commit(batch, changes)
    encode, want = byte_bpe(vocabulary(BPE)), Counter()
    for r in docs.collect():
        if r.doc_id % 10:
            moved = r.doc_id % 10 == 1
            key = f"byte_bpe_50k@{1 + moved}"
            want[key, "documents"] += 1
            want[key, "tokens"] += len(encode(r.text or "")) + moved
    got = {(r.tokenizer_version, k): r[k] for r in kept.totals().collect() for k in ("documents", "tokens")}
    assert got == dict(want)
