"""Quality rules, near copies, decontamination, urls, archives and toxicity against plain versions."""

import base64
import hashlib
import random
import re
from collections import Counter

import pytest

from waymark.llm import decontamination, ngram_join, quality, toxicity, url_rules, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def vocabulary(r, n=400):
    return ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(n)]


def odd_texts():
    r = random.Random(5)
    v = vocabulary(r)
    out = [" ".join(r.choices(v, k=r.randint(0, 120))) for _ in range(120)]
    out += [None, "", " \n\t ", "one", "a\x0cb c", "line here\n" * 30, ("x y z " * 40), "né\xa0e # $ %\r\n#", "same words all over " * 20 + " ".join(v[:60])]
    return out


def test_quality_base_equals_a_plain_count(spark):
    some = odd_texts()
    docs = spark.createDataFrame([(i if i != 3 else None, t, 1) for i, t in enumerate(some)], "doc_id long, text string, kept int")
    got = {r.doc_id: r for r in quality.repetition(docs).collect()}
    for i, t in enumerate(some):
        row, t = got[i if i != 3 else None], t or ""
        w = WORD.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = set()
        for j in range(len(w) - 2):
            if grams[w[j], w[j + 1], w[j + 2]] > 1:
                hit |= {j, j + 1, j + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        assert row.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (row.base_failed and row.kept)


def test_quality_shares_equal_a_plain_count():
    r = random.Random(2)
    text = " ".join(r.choices("a bb ccc".split(), k=200))
    w = text.split()
    row = {k: v[0] for k, v in quality.measure([text], quality.Limits(repeated={5: 2.0}, top={2: 2.0})).items()}
    seen, hit = set(), set()
    for j in range(len(w) - 4):
        g = tuple(w[j : j + 5])
        if g in seen:
            hit |= set(range(j, j + 5))
        seen.add(g)
    chars = sum(map(len, w))
    assert row["max_repeated_share"] == pytest.approx(sum(len(w[j]) for j in hit) / chars)
    pairs = Counter(zip(w, w[1:]))
    top = max(pairs.values())
    assert row["max_top_share"] == pytest.approx(min(1, max(top * sum(map(len, p)) for p, c in pairs.items() if c == top) / chars))


def plain_groups(rows, n=4, percent=85):
    def grams(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(s), k if not s else least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("unit", [400, 5])
def test_groups_equal_all_pairs(spark, unit, monkeypatch):
    monkeypatch.setattr(ngram_join, "_UNIT", unit)
    monkeypatch.setattr(ngram_join, "_BLOCK_ROWS", 2048 if unit == 400 else 3)
    r = random.Random(unit)
    v = vocabulary(r)
    passage = r.choices(v, k=25)
    rows = []
    for _ in range(12):
        base = r.choices(v, k=r.choice([3, 8, 40, 90]))
        for _ in range(r.choice([1, 2, 9, 25])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(v)
            rows.append((len(rows) * 3 + 1, " ".join(w)))
        rows.append((len(rows) * 3 + 1, " ".join(passage + r.choices(v, k=6))))
    rows += [(90001, None), (90002, ""), (90003, " \t"), (None, rows[0][1]), (5, rows[3][1]), rows[7], (90004, "One two"), (90005, "one  TWO")]
    r.shuffle(rows)
    docs = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, component_id int").repartition(3)
    got = ngram_join.similar_groups(docs).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(map(tuple, got), key=key) == sorted(plain_groups(rows), key=key)
    left = ngram_join.representatives(docs)
    assert left.columns == docs.columns
    assert {x.doc_id for x in left.collect() if x.doc_id is not None} == {k for k, _, c in plain_groups(rows) if k is not None and k == c}


def test_groups_of_an_empty_table(spark):
    assert ngram_join.similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


ITEM = "A train travels 60 miles in 2 hours while Anna reads a long book about the quiet sea and the old harbour"
SAME = "A train travels 85 miles in 3 hours while Boris reads a long book about the quiet sea and the old harbour"


def test_templates_catch_other_parameters_and_spare_other_texts(spark):
    noise = " ".join(vocabulary(random.Random(1))[:120])
    rows = [(1, f"{noise} {ITEM} {noise}"), (2, f"{noise}. {SAME}. {noise}"), (3, noise), (4, None), (5, ""), (6, noise + " the quiet sea and the old harbour"), (None, ITEM), (1, noise), (7, ITEM[:60])]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, coverage string")
    bench = spark.createDataFrame([(10, ITEM), (11, None), (12, "seven short words of this other item"), (None, ITEM)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (None, 10)}
    assert got[2, 10].n_exact < got[2, 10].n_matched
    assert got[1, 10].n_exact == got[1, 10].n_matched
    left = decontamination.clean(docs, bench).collect()
    assert sorted((r.doc_id, r.text) for r in left if r.doc_id in (1, 3)) == [(1, noise), (3, noise)]
    assert not any(r.text and ITEM in r.text for r in left)


def test_inconsistent_slots_are_no_match(spark):
    item = "from 12 to 12 and then from 12 back to the old gate near the green hill"
    other = "from 3 to 4 and then from 9 back to the old gate near the green hill"
    docs = spark.createDataFrame([(1, item), (2, other)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.contaminated(docs, bench).collect()} == {1}
    assert decontamination.contaminated(docs.limit(0), bench).collect() == []
    assert decontamination.contaminated(docs, bench.limit(0)).collect() == []


def words_of(item, n, r):
    return ["".join(r.choices("abcdefghijklmnop", k=9)) for _ in range(n)]


def test_slots_of_one_value_may_part_and_altered_copies_are_found(spark):
    r = random.Random(8)
    tail = " ".join(words_of(None, 10, r))
    twice = f"she buys 2 apples and also 2 pears at the market before noon {tail}"
    parted = f"she buys 3 apples and also 5 pears at the market before noon {tail}"
    long_item = " ".join(x for k in range(12) for x in [*words_of(None, 4, r), "Mara" if k % 3 == 0 else "and"])
    altered = long_item.replace("Mara", "Ines", 1)
    spread = words_of(None, 38, r)
    edited = list(spread)
    for at in (9, 19, 29):
        edited[at] = "changed"
    half = " ".join(spread[:12] + words_of(None, 30, r))
    docs = spark.createDataFrame([(1, parted), (2, f"so {altered}"), (3, " ".join(edited)), (4, half), (3, " ".join(edited))], "doc_id long, text string")
    bench = spark.createDataFrame([(10, twice), (20, f"so {long_item}"), (30, " ".join(spread))], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(docs, bench).collect()}
    assert got == {(1, 10), (2, 20), (3, 30)}


def plain_share(pairs):
    """Repeats of slot values and those that agree, counted one by one in both directions."""
    sides = []
    for one in (pairs, [(v, k) for k, v in pairs]):
        by = {}
        for k, v in one:
            by.setdefault(k, []).append(v)
        sides.append((sum(len(x) - 1 for x in by.values()), sum(max(x.count(v) for v in x) - 1 for x in by.values())))
    repeats = sides[0][0] + sides[1][0]
    return 1.0 if max(sides[0][0], sides[1][0]) <= 1 else (sides[0][1] + sides[1][1]) / repeats


NAMES = "Anna Boris Clara David Elena Felix Greta Henri".split()


def test_slot_consistency_decides_between_copies_and_contradictions(spark):
    """200 items of repeated names and numbers: each with a re-parameterised copy whose slots contradict it to some degree."""
    r = random.Random(31)
    bench, docs, want, shares = [], [], {}, []
    for i in range(200):
        words = words_of(None, 24, r)
        slots = [r.choice([*NAMES[:3], "30", "45", "7"]) for _ in range(8)]
        fresh = dict(zip([*NAMES[:3], "30", "45", "7"], [*r.sample(NAMES[3:], 3), *r.sample(["81", "92", "63", "54"], 3)]))
        wrong = r.choice((0.0, 0.3, 1.0))
        other = [(r.choice(NAMES) if x in NAMES else str(r.randint(10, 99))) if r.random() < wrong else fresh[x] for x in slots]
        put = lambda values: " ".join(x for k, v in enumerate(values) for x in (*words[3 * k : 3 * k + 3], v))  # noqa: E731, B023
        bench.append((i, "so " + put(slots)))
        docs.append((i, "so " + put(other)))
        want[i] = plain_share([(a.lower(), b.lower()) for a, b in zip(slots, other)])
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for least in (0.0, 0.5, 1.0):
        got = {x.doc_id: x.consistency for x in decontamination.contaminated(d, b, consistent=least).collect() if x.doc_id == x.item_id}
        assert got == pytest.approx({i: s for i, s in want.items() if s >= least})
        shares.append(len(got))
    assert shares[0] == 200 > shares[1] > 110 and shares[1] > shares[2] > 50


def test_contradicting_names_and_numbers_are_no_match(spark):
    item = "so Anna has 30 red balls while the other girl with Anna carries 30 green ones over the bridge"
    other = "so Anna has 30 red balls while the other girl with Boris carries 77 green ones over the bridge"
    turned = item.replace("Anna", "Clara").replace("30", "81")
    two = "so Anna has 30 red balls while the other girl with Boris carries 77 green ones over the bridge"
    merged = "so Clara has 81 red balls while the other girl with Clara carries 81 green ones over the bridge"
    docs = spark.createDataFrame([(1, item), (2, other), (3, turned), (4, merged)], "doc_id long, text string")
    find = lambda x: {r.doc_id for r in decontamination.contaminated(docs, spark.createDataFrame([(1, x)], "item_id long, text string")).collect()}
    assert find(item) == {1, 3, 4} and find(two) == {2}


def test_items_of_names_and_numbers_are_found_as_they_are(spark):
    item = "so Anna 12 Boris 45 Clara 77 David 81 Elena 90 Felix 14"
    copy, other = f"some words before {item} and behind", item.replace("12", "13").replace("Clara", "Greta")
    docs = spark.createDataFrame([(1, copy), (2, other.replace("81", "82")), (3, "9 Anna 8 Boris " * 2000)], "doc_id long, text string")
    got = decontamination.contaminated(docs, spark.createDataFrame([(1, item), (2, "Only")], "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(1, 1)}


def test_windows_beyond_the_broadcast_are_joined_by_hash(spark, monkeypatch):
    r = random.Random(2)
    items = [(k, " ".join(words_of(None, 20, r))) for k in range(30)]
    long_text = " ".join([*words_of(None, 30_000, r), items[3][1], *words_of(None, 500, r)])
    docs = spark.createDataFrame([(1, items[7][1]), (2, long_text), (3, long_text[:9000])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    few = sorted(tuple(x) for x in decontamination.contaminated(docs, bench).drop("text_hash").collect())
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert sorted(tuple(x) for x in decontamination.contaminated(docs, bench).drop("text_hash").collect()) == few
    assert [x[:2] for x in few] == [(1, 7), (2, 3)]


def test_url_rules_equal_a_plain_search(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("a.b.com", "/", "block"), ("b.com", "", "allow"), ("b.com", "/x", "block")]
    hosts = ["org", "example.org", "blog.Example.org", "notexample.org", "com", "b.com", "a.b.com", "z.a.b.com", "ab.com", "net", "", "org.", "x..org"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/es/1", "/en/12?q#f", "/fr/", "/x?y", "?q=/es/", "#/")] + [None, "", "no url", "://", "HTTP://EXAMPLE.ORG/ES/", "http://a\nb.org/x"]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[3], "x"), (0, urls[0], "x")]
    got = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string, host string"), spark.createDataFrame(rules, "host string, path string, verdict string"), "maybe").collect()

    def plain(u):
        rest = u.partition("://")[2] if u else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = sorted((-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p))
        return host, path, fit[0][1] if fit else None, fit[0][2] if fit else "maybe"

    key = lambda x: tuple((y is not None, str(y)) for y in x)
    assert sorted(map(tuple, got), key=key) == sorted(((i, *plain(u)) for i, u, _ in rows), key=key)


def test_archives_come_back(spark):
    rows = [(5, "http://a/", "same"), (3, "http://b/ü x", "same"), (None, None, "same"), (9, "http://c/", None), (2, "x", ""), (7, "y", "ü" * 5000), (5, "http://a/", "same"), (1, "z", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload_bytes int").repartition(3)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    by = {}
    for i, _, h in rows:
        by.setdefault(h or "", []).append(i)
    for h, ids in by.items():
        raw = h.encode()
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        mine = [r for r in got if r.payload_digest == sha]
        assert sorted(map(str, ids)) == sorted(str(r.page_id) for r in mine)
        first = min(i for i in ids if i is not None)
        assert [r.page_id for r in mine if r.record_type == "response"] == [first]
        assert all(r.payload_bytes == len(raw) and r.refers_to == (first if r.record_type == "revisit" else None) for r in mine)
    assert warc.round_trip(pages.limit(0)).collect() == []
    assert {r.record_type for r in warc.round_trip(pages, min_bytes=10**6).collect()} == {"response"}


def labelled(swap_weight):
    r = random.Random(3)
    v = vocabulary(r)
    rows = []
    for i in range(600):
        w = r.choices(v, k=30)
        toxic = i % 5 == 0
        if toxic:
            w[r.randrange(30)] = r.choice(["idiot", "scum", "moron"])
            if r.random() < 0.7:
                w[r.randrange(30)] = "muslim"
        elif r.random() < 0.03:
            w[r.randrange(30)] = "muslim"
        rows.append((i, " ".join(w), int(toxic)))
    return rows, v


def test_swaps_keep_neutral_mentions_neutral(spark):
    rows, v = labelled(1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    plain = toxicity.fit(docs, labels, toxicity.Settings(counterfactual=0.0))
    fair = toxicity.fit(docs, labels, toxicity.Settings(counterfactual=5.0))
    neutral = [" ".join([*v[:20], "muslim"])]
    assert fair.scores(neutral)[0] < plain.scores(neutral)[0]
    assert abs(fair.scores(neutral)[0] - fair.scores([toxicity.swapped(neutral[0])])[0]) < 0.05
    base = [" ".join(random.Random(k).choices(v, k=29)) for k in range(20)]
    for model in (plain, fair):
        assert (model.scores([t + " scum" for t in base]) > model.scores(base)).all()
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "scum " * 9), (2, "scum " * 9)], "doc_id long, text string")
    got = toxicity.score(odd, fair).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert toxicity.clean(odd, fair).count() == sum(r.predicted == 0 for r in got)


def test_mentions_are_put_into_texts_that_have_none():
    forms = toxicity.counterfactuals("plain words")
    assert len(forms) == 3 and forms[0] == "plain words" and forms[1] != forms[2] and all(x.startswith("plain words ") for x in forms[1:])
    assert toxicity.counterfactuals("two Women here") == ["two Women here", "two men here"]
    assert len(toxicity.counterfactuals("")) == 3


def test_false_positives_on_neutral_mentions_fall_with_the_penalty(spark):
    """Stems of toxic words that are also stems of identity terms: without the penalty a mention raises the score."""
    r = random.Random(4)
    v = vocabulary(r)
    rows = []
    for i in range(500):
        w = r.choices(v, k=25)
        if i % 4 == 0:
            w[r.randrange(25)] = r.choice(["whitener", "muslimo", "blackest", "gaylord"])
        rows.append((f"doc{i}", " ".join(w), int(i % 4 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [rows[0][:2]], "doc_id string, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id string, toxic int")
    clean = [t for _, t, y in rows if not y][:100]
    flagged = {}
    for weight in (0.0, 1.0):
        model = toxicity.fit(docs, labels, toxicity.Settings(counterfactual=weight))
        flagged[weight] = sum((model.scores([f"{t} {term}" for t in clean]) - model.scores(clean)).mean() for term in ("white", "muslim", "black"))
    assert flagged[1.0] < 0.5 * flagged[0.0]
    empty = toxicity.score(docs.limit(0), model)
    assert empty.collect() == [] and toxicity.clean(docs.limit(0), model).collect() == []


def test_without_labels_every_score_is_the_same(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()}) == 1
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert len({r.score for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()}) == 1
