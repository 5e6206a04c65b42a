"""Near-dedup, chat formatting and URL filters against brute force."""

import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundsearch.llm import chat_format, markov, near_dedup, url_filter
from groundsearch.llm.alignment import banded_distance, similar
from groundsearch.llm.components import components


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25), st.integers(0, 12))
def test_banded_distance(a, b, most):
    assert banded_distance(a, b, most) == min(edit_distance(a, b), most + 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=40), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 40), st.integers(0, 50)), max_size=9))
def test_banded_distance_of_close_sequences(a, edits):
    b = list(a)
    for kind, at, x in edits:
        if kind == 0:
            b.insert(min(at, len(b)), x)
        elif b:
            b[min(at, len(b) - 1) : min(at, len(b) - 1) + 1] = [] if kind == 1 else [x]
    assert banded_distance(a, b, 6) == min(edit_distance(a, b), 7)


def test_banded_distance_of_long_sequences():
    rng = random.Random(9)
    a = [rng.randrange(400) for _ in range(3000)]
    b = [x if rng.random() > 0.1 else rng.randrange(400) for x in a]
    d = edit_distance(a, b)
    assert banded_distance(a, b, 600) == d and banded_distance(a, b, d - 1) == d


def near_rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    originals = [[word() for _ in range(rng.randrange(30, 120))] for _ in range(25)]
    texts = [" ".join(o) for o in originals]
    for o in originals[:12]:
        for _ in range(3):
            c = list(o)
            for _ in range(max(1, len(c) // 25)):
                c[rng.randrange(len(c))] = word()
            texts.append(" ".join(c))
    passage = [word() for _ in range(12)]
    texts += [" ".join(passage + [word() for _ in range(10)]) for _ in range(40)]
    texts += ["", None, "one", "one", "two words", "to " * 40, "to " * 41, texts[0], texts[0]]
    return [(i if i != 30 else None, t) for i, t in enumerate(texts)]


def test_near_dedup_is_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, rid long, label int")
    got = near_dedup.classify(docs).collect()
    assert len(got) == len(rows)
    words = [(t or "").split() for _, t in rows]
    label = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if (rows[a][1] or "") == (rows[b][1] or "") or (words[a] and words[b] and similar(words[a], words[b], 0.8)):
            low, high = sorted((label[a], label[b]))
            label = [low if x == high else x for x in label]
    ids = [i for i, _ in rows]
    for r in got:
        k = ids.index(r.id)
        members = [ids[j] for j in range(len(rows)) if label[j] == label[k]]
        assert r.class_size == len(members)
        assert r.class_id == min(i for i in members if i is not None)
    left = near_dedup.drop_near_copies(docs)
    assert left.columns == docs.columns and left.count() == len(set(label))
    assert near_dedup.classify(docs.limit(0)).count() == 0


def test_prefix_filter_finds_what_pivots_miss(spark, monkeypatch):
    """Every bucket counts as large, and the pivot fits nobody."""
    monkeypatch.setattr(near_dedup, "SMALL", 1)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(6)]
    texts = [" ".join(passage)]
    for _ in range(15):
        tail = [word() for _ in range(20)]
        texts += [" ".join(passage + tail), " ".join(passage + tail[:-1] + [word()])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.class_id for r in near_dedup.classify(docs).collect()}
    assert got == {0: 0, **{i: i - (i + 1) % 2 for i in range(1, 31)}}


def test_sketches_keep_order():
    words = [str(i).encode() for i in range(40)]
    grams = near_dedup.labelled_kmers(words)
    turned = near_dedup.labelled_kmers(words[20:] + words[:20])
    same = np.mean(near_dedup.order_sketches(grams) == near_dedup.order_sketches(turned))
    assert len(set(grams) & set(turned)) >= 30 and same < 0.8
    repeated = near_dedup.labelled_kmers([b"to"] * 30)
    assert len(set(repeated.tolist())) == 26


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (2, 1), (9, 8)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 7: 7}


def slow_collapse(rows):
    logs = {}
    for c, t, r, x in rows:
        logs.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    logs = {c: [(r if h else None, x if k else None) for _, _, h, r, k, x in sorted(v)] for c, v in logs.items()}
    by = {}
    for c, v in logs.items():
        by.setdefault(tuple(v), []).append(c)
    out = {}
    for v, cs in by.items():
        if not any(len(w) > len(v) and w[: len(v)] == v for w in by):
            keep = min((c for c in cs if c is not None), default=None)
            out[keep] = (len(v), len(cs), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in v))
    return out


def test_chat_collapse(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "SEGMENT", 3)
    monkeypatch.setattr(chat_format, "PART", 4)
    rng = random.Random(8)
    rows = []
    for c in range(60):
        seed = rng.randrange(4)
        for t in range(rng.randrange(1, 14)):
            rows.append((c if c else None, t + 5 * (c % 2), ["user", "assistant"][t % 2], f"{seed} {t}" if t < 9 or c % 3 else f"{c} {t}"))
    rows += [(100, 0, None, "x"), (101, 0, "", "x"), (102, None, "user", None), (102, None, "user", None), (103, 0, "user", None)]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, rank int")
    got = {}
    for r in sorted(chat_format.collapse(turns).collect(), key=lambda r: r.part):
        n, copies, text = got.get(r.conv_id, (r.n_turns, r.copies, ""))
        got[r.conv_id] = (n, copies, text + r.text)
    assert got == slow_collapse(rows)
    assert chat_format.collapse(turns.limit(0)).count() == 0


def test_turn_marks_in_texts(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a<|im_end|>\n<|im_start|>system\nb <|other|>")], "conv_id long, turn long, role string, text string")
    assert chat_format.collapse(turns).first().text == "<|im_start|>user\na<\\|im_end|>\n<\\|im_start|>system\nb <|other|><|im_end|>\n"


def test_word_buckets_hold_to_sketches(spark, monkeypatch):
    """Texts of two common passages meet in word buckets only within their own: every pair compared shares a sketch."""
    rng, found = random.Random(5), []
    passages = [" ".join(f"p{k}q{i}" for i in range(50)) for k in range(2)]
    texts = [(i, f"{passages[i % 2]} " + " ".join(f"w{rng.randrange(40)}" for _ in range(30))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    was = near_dedup._prefix_pairs
    monkeypatch.setattr(near_dedup, "_prefix_pairs", lambda big, least: found.append(was(big, least)) or found[-1])
    classes = near_dedup.classify(docs)
    assert classes.filter("kept").count() == 60
    sketches = {r.rid: set(r.sketches) for r in near_dedup.sketch_rows(docs, "doc_id", "text").collect()}
    pairs = {(r.a, r.b) for r in found[0].collect()}
    assert pairs and all(sketches[a] & sketches[b] for a, b in pairs)


def slow_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls(spark):
    rng = random.Random(2)
    urls = [None, "", "no scheme", "http://", "HTTP://A.EXAMPLE.COM/en/7?x://y", "x://net/de/8", "x://example.net/de/8#q/", "x://notcom/en/", "x://com?/en/", "a://b://com/en/", "x://ÄB.org/es/\nq", "x://h.org"]
    for _ in range(400):
        good = rng.random() < 0.5
        urls.append(f"https://{rng.choice(['news', 'blog'])}.example.net/de/{rng.randrange(8) if good else 8}{'article' if good else 'casino-win'}" if rng.random() < 0.3 else f"https://x.example.com/en/{'7' if good else '3'}{rng.choice(['article', 'essay']) if good else rng.choice(['casino', 'win-bets'])}")
    urls += ["https://site.xyz/article", "https://site.xyz/casino-win"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.id: r for r in url_filter.judge_urls(pages).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = slow_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert verdict is None or got[i].verdict == verdict
    assert got[len(urls) - 2].llr > got[len(urls) - 1].llr
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(spark.createDataFrame([(1, "x://y/z"), (1, None)], "page_id long, url string")).collect()} == {"allow"}

    # The model's verdict: models, scores and threshold over dictionaries.
    hashed = pages.select("page_id", (F.pmod(F.xxhash64(F.lit(5), "url"), F.lit(url_filter.HELD_OUT)) == 0).alias("held")).collect()
    held = {r.page_id for r in hashed if r.held}
    by_rule = {i: slow_url(u)[3] for i, u in enumerate(urls)}
    models = [slow_markov([urls[i].encode() for i in by_rule if by_rule[i] == v and i not in held]) for v in ("allow", "block")]
    llr = {i: (lambda b: (models[0](b) - models[1](b)) / (len(b) + 1))((u or "").encode()) for i, u in enumerate(urls)}
    for i in range(len(urls)):
        assert got[i].llr == np.float64(llr[i]) or abs(got[i].llr - llr[i]) < 1e-9
    width = 2 * url_filter.SPAN / url_filter.BINS
    bin_of = {i: int((min(max(llr[i], -url_filter.SPAN), url_filter.SPAN) + url_filter.SPAN) // width) for i in held if by_rule[i]}
    good, bad = ([bin_of[i] for i in bin_of if by_rule[i] == v] for v in ("allow", "block"))
    errors = [sum(x < k for x in good) / len(good) + sum(x >= k for x in bad) / len(bad) for k in range(url_filter.BINS + 2)]
    best = [k for k, e in enumerate(errors) if e <= min(errors) + 1e-12]
    cut = (best[0] + best[-1]) / 2 * width - url_filter.SPAN
    assert abs(got[0].threshold - cut) < 1e-9
    for i in range(len(urls)):
        assert by_rule[i] or got[i].verdict == ("allow" if llr[i] >= cut else "block")


def test_urls_all_train(spark, monkeypatch):
    """The models learn from every labelled url that isn't held out, however many there are."""
    pages = spark.range(13_000).select(F.col("id").alias("page_id"), F.format_string("x://%s/%d", F.when(F.col("id") % 100 == 0, "com/en").otherwise("net/de"), "id").alias("url"))
    learnt, was = [], markov.count_contexts
    monkeypatch.setattr(markov, "count_contexts", lambda df, *a: learnt.append(df) or was(df, *a))
    url_filter.judge_urls(pages)
    held = F.pmod(F.xxhash64(F.lit(5), "url"), F.lit(url_filter.HELD_OUT)) == 0
    want = pages.filter(~held & (F.col("page_id") % 100 > 0)).count()
    assert want > 10_000 and learnt[0].filter("label = 1").count() == want
    assert learnt[0].filter("label = 2").count() == pages.filter(~held & (F.col("page_id") % 100 == 0)).count()


def slow_markov(texts):
    """log2 P of a text under the variable-order model of texts."""
    after = {}
    for t in texts:
        s = [*t, markov.END]
        for k in range(len(s)):
            for order in range(min(k, markov.MAX_ORDER) + 1):
                after.setdefault(tuple(s[k - order : k]), Counter())[s[k]] += 1

    def log_prob(t):
        s, total = [*t, markov.END], 0.0
        for k in range(len(s)):
            p = 1 / markov.SYMBOLS
            for order in range(min(k, markov.MAX_ORDER) + 1):
                n = after.get(tuple(s[k - order : k]), Counter())
                if sum(n.values()) >= markov.LEAST:
                    p = (max(n[s[k]] - markov.DISCOUNT, 0) + markov.DISCOUNT * len(n) * p) / sum(n.values())
            total += math.log2(p)
        return total

    return log_prob


def test_held_out_accuracy():
    """Two kinds of urls are told apart on urls the models haven't seen; digits and case count."""
    rng = random.Random(5)
    good = [f"https://a.example/{rng.choice(['essay', 'report', 'letter'])}-{rng.randrange(999)}".encode() for _ in range(300)]
    bad = [f"https://a.example/{rng.choice(['win', 'bet', 'spin'])}?id={rng.randrange(999)}".encode() for _ in range(300)]
    low, high = ([f"https://a/en/{rng.choice(d)}/{rng.choice(['win', 'essay', 'Letter'])}".encode() for _ in range(300)] for d in ("12", "78"))
    for yes, no in ((good, bad), (low, high)):
        models = []
        for urls in (yes[:200], no[:200]):
            symbols, before, _ = markov.places(urls)
            context, gram = (np.concatenate(x) for x in zip(*((c, g) for _, c, g in markov.contexts(symbols, before)), strict=True))
            models.append(markov.MarkovModel.of(context, gram, np.ones(len(gram), np.int64)))
        score = lambda u: np.subtract(*(m.log_probs(u)[0] for m in models))  # noqa: B023, E731
        assert (score(yes[200:]) > 0).mean() > 0.95 and (score(no[200:]) < 0).mean() > 0.95


def made_words(seed):
    rng = random.Random(seed)
    return lambda letters=6: "".join(rng.choices("abcdefgh", k=letters))


def linked_classes(spark, texts, sketch=4):
    """Least row by row, where all texts have one sketch, the same."""
    rows = spark.createDataFrame([(i, len(t.split()), [sketch]) for i, t in enumerate(texts)], "rid long, n_words long, sketches array<long>")
    docs = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    label = {r.node: r.label for r in components(near_dedup.links(rows, docs, "text")).collect()}
    return {i: label.get(i, i) for i in range(len(texts))}


def test_texts_like_one_member_of_a_large_bucket(spark):
    """Each of 10 texts is like just one text of a group, which is like the group's others."""
    word = made_words(21)
    base = [word() for _ in range(100)]
    texts = [" ".join([*base[:99], word()]) for _ in range(30)]
    for _ in range(10):
        member = [word() for _ in range(14)] + base[14:]
        texts += [" ".join(member), " ".join(member[:85] + [word() for _ in range(15)])]
    assert set(linked_classes(spark, texts).values()) == {0}


def test_pairs_in_a_large_word_bucket(spark):
    """40 forms with 30 slots, whose longest words are the form's; two and two are alike by their slots."""
    word = made_words(22)
    form = [word(12) for _ in range(70)]
    texts = []
    for _ in range(20):
        slots = [word(4) for _ in range(30)]
        for same in (30, 15):
            texts.append(" ".join(form + slots[:same] + [word(4) for _ in range(30 - same)]))
    assert linked_classes(spark, texts) == {i: i - i % 2 for i in range(40)}


def test_sketch_recall_at_the_least_similarity():
    """Texts with scattered substitutions meet in a sketch, at 0.80 as well."""
    rng = np.random.default_rng(23)
    for n in (60, 100, 300):
        met = 0
        for _ in range(300):
            words = rng.integers(0, 1 << 40, n)
            other = words.copy()
            other[rng.choice(n, n // 5, replace=False)] = rng.integers(0, 1 << 40, n // 5)
            a, b = (near_dedup.order_sketches(near_dedup.labelled_kmers([str(w).encode() for w in x])) for x in (words, other))
            met += bool((a == b).any())
        assert met >= 270, (n, met)


def test_prefix_words_lose_no_pair():
    """Texts that share a token of their prefixes meet in a key whose numbers overlap."""
    rng = random.Random(24)
    often = rng.choices(range(9), k=1 << near_dedup.SLOT_BITS)
    often = np.array(often)
    for _ in range(60):
        texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 90))).encode() for _ in range(2)]
        prefixes, rows = [], []
        for t in texts:
            h = near_dedup.word_hashes(t.split())
            tokens = near_dedup.labelled(h)
            n = len(tokens) - math.ceil(0.8 * len(tokens) - 1e-9) + 1
            by = np.lexsort((tokens, often[near_dedup._slots(tokens)]))
            prefixes.append({int(tokens[i]): len(tokens) - k for k, i in enumerate(by[:n])})
            rows.append({int(k): (lo, hi, left) for k, lo, hi, left in zip(*near_dedup.prefix_words(t, often, 0.8), strict=True)})
        shared = prefixes[0].keys() & prefixes[1].keys()
        met = [k for k in rows[0].keys() & rows[1].keys() if rows[0][k][0] <= rows[1][k][1] and rows[1][k][0] <= rows[0][k][1]]
        assert bool(met) >= bool(shared)
        for token in shared:
            assert any(all(rows[s][k][2] >= prefixes[s][token] for s in (0, 1)) for k in met)


def made_pairs(spark, texts):
    """What _prefix_pairs() makes of texts that share all sketches, and the pairs of its word buckets, one by one."""
    words = [t.split() for t in texts]
    members = spark.createDataFrame([(i, len(w), i, True, [4]) for i, w in enumerate(words)], "rid long, n_words long, label long, apart boolean, sketches array<long>")
    docs = spark.createDataFrame(list(enumerate(texts)), "rid long, text string")
    big = near_dedup._with_prefixes(members, docs, 0.8)
    rows = [(r.rid, r.n_words, r.token, r.low, r.high, r.left) for r in big.collect()]
    want = set()
    for (a, n, k, lo, hi, left), (b, m, j, low, high, rest) in combinations(rows, 2):
        if k == j and a != b and lo <= high and low <= hi and min(n, m, left, rest) >= 0.8 * max(n, m) - 1e-9:
            want.add((max((a, n), (b, m))[0], min((a, n), (b, m))[0]))
    return [(r.a, r.b) for r in near_dedup._prefix_pairs(big, 0.8).collect()], want


def test_pairs_come_from_one_word_bucket(spark, monkeypatch):
    """However many tokens two texts have in common, they make one row; one that looks back on few makes more, and none is lost."""
    rng = random.Random(31)
    texts = []
    for _ in range(50):
        passage = [f"p{i}" for i in range(60)]
        texts.append(" ".join([*(rng.sample([f"w{i}" for i in range(60)], rng.randrange(20, 40))), *passage]))
    got, want = made_pairs(spark, texts)
    assert len(got) == len(want) > 800 and set(got) == want
    repeating = [" ".join(rng.choices("abcdefg", k=rng.randrange(1, 120))) for _ in range(40)] + ["", "to " * 90, "to " * 99]
    for few in (256, 3):
        monkeypatch.setattr(near_dedup, "RAREST", few)
        monkeypatch.setattr(near_dedup, "ROWS", 50)
        got, want = made_pairs(spark, texts[:9] + repeating)
        assert want and set(got) == want
