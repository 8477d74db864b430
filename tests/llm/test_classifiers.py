import math
import random
import re

import numpy as np
import pytest

from textgauge.llm import language, toxicity
from textgauge.llm.toxicity import AIMED, BACK, BOUNDARY, CUES, INSULT, NEGATED, NEGATION, ONWARD, OTHER, REPORT, REPORTED, TARGET, THREAT, Lexicon
from textgauge.llm.url_filter import Rule, judge_urls, site_rule

PARTS = {"aa": "the of and ing er on th".split(), "bb": "el la de ción es en co".split(), "cc": "der und ung sch ein ie".split()}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language(spark):
    rng = random.Random(5)
    langs = [rng.choice(list(PARTS)) for _ in range(400)]
    rows = [(i, prose(rng, g, rng.randint(3, 120)), g, "x") for i, g in enumerate(langs)]
    rows += [(900, None, None, "x"), (901, "", "aa", "x"), (902, "12 %% 7", "bb", "x"), (903, prose(rng, "cc", 60000), None, "x"), (None, rows[0][1], None, "x"), (0, rows[0][1], langs[0], "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language.identify(d, d.where("doc_id % 2 = 0")).collect()
    assert len(got) == len(rows)
    pred = {r.doc_id: r for r in got}
    right = sum(pred[i].lang_pred == g for i, g in enumerate(langs) if i % 2)
    assert right >= 190
    assert [pred[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and pred[901].score == 0
    assert pred[903].lang_pred == "cc" and pred[None].lang_pred == pred[0].lang_pred
    assert all(0 <= r.score <= 1 for r in got)
    none = language.identify(d, d.where("false")).select("lang_pred").distinct().collect()
    assert [r[0] for r in none] == ["und"]
    assert language.identify(d.limit(0), d).count() == 0


def marks_by_looking_around(kinds):
    """Marks of each insult and threat, from the cues around it."""
    out = []
    for i, k in enumerate(kinds):
        marks = 0
        if k in (INSULT, THREAT):
            for mark, (cue, onward, behind, stops) in CUES.items():
                for side, reach in ((kinds[:i][::-1], onward), (kinds[i + 1 :], behind)):
                    if stops and BOUNDARY in side:
                        side = side[: side.index(BOUNDARY)]
                    marks |= mark * (cue in [x for x in side if x != BOUNDARY][:reach])
        out.append(marks)
    return out


def test_grammar_against_looking_around():
    rng = random.Random(1)
    kinds = [OTHER, OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BOUNDARY]
    for _ in range(500):
        s = [rng.choice(kinds) for _ in range(rng.randint(1, 20))]
        back = BACK.read(s[::-1])[0][::-1]
        read = ONWARD.read(back)[0]
        assert [x % toxicity.SYMBOLS for x in read] == s
        assert [x // toxicity.SYMBOLS for x in read] == marks_by_looking_around(s)
        factors = {"bare": 0.5, "aimed": 1.0, "threat": 2.0, "negated": 0.25, "reported": 0.125}
        out, logs = ONWARD.compose(toxicity.weigher(factors)).read(back)
        for k, marks, x, f in zip(s, marks_by_looking_around(s), out, logs, strict=True):
            match = k == INSULT or (k == THREAT and marks & AIMED and not marks & NEGATED)
            want = (2.0 if k == THREAT else 1.0 if marks & AIMED else 0.5) * (0.25 if marks & NEGATED else 1) * (0.125 if marks & REPORTED else 1)
            assert (x % toxicity.SYMBOLS in (INSULT, THREAT)) == bool(match)
            assert not match or math.exp(f) == pytest.approx(want)


def test_composition_is_one_after_another():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randrange(toxicity.SYMBOLS) for _ in range(rng.randint(1, 15))]
        out = s
        for mark, (cue, onward, _, stops) in CUES.items():
            out = toxicity.marker(mark, cue, onward, stops).read(out)[0]
        assert ONWARD.read(s)[0] == out


def test_clauses_not_words():
    lex = Lexicon({"moron$": 5.0, "vequ": 4.0})
    bare, aimed = lex.clauses("a moron here")[0], lex.clauses("you moron here")[0]
    mentioned, threat = lex.clauses("the word moron is from greek")[0], lex.clauses("I will kill you")[0]
    assert aimed > bare > mentioned and threat > 2.0
    assert lex.clauses("moron like you")[0] == aimed and lex.clauses("this is surely not a moron")[0] < bare
    assert lex.clauses("you moron, she said")[0] < aimed and lex.clauses("she said that some are a moron")[0] < bare
    # a threat needs a target, in its own clause
    assert lex.clauses("they would never kill anyone today or ever") == [] == lex.clauses("kill time, you said")
    assert lex.clauses("I will kill it") != []
    assert len(lex.clauses("moron. fine words! VEQUer, moron")) == 3
    assert lex.clauses("moronic words") == [] and lex.clauses("") == lex.clauses(None) == []
    assert lex.clauses("unvequ oxymoron") == []
    long = "fine day here, " * 100_000 + "you moron"
    assert lex.clauses(long) == [aimed]


def ends_of(words, steps, between=toxicity.BETWEEN):
    """Places where a pattern can end, by trying every choice of places."""
    fits = lambda w, step: any(w.startswith(x[:-1]) if x.endswith("*") else w == x for x in step)
    at = {i for i, w in enumerate(words) if fits(w, steps[0])}
    for step in steps[1:]:
        at = {j for i in at for j in range(i + 1, min(len(words), i + 2 + between)) if fits(words[j], step) and "," not in words[i:j]}
    return at


def test_patterns_against_trying_all():
    rng = random.Random(8)
    phrases = {INSULT: ["a b", "a|b c* a", "c c c"], THREAT: ["b c", "d a|b d"]}
    machine = toxicity.Patterns(phrases)
    for _ in range(600):
        words = [rng.choice(["a", "b", "c", "cx", "d", "x", ","]) for _ in range(rng.randint(0, 14))]
        want = [OTHER] * len(words)
        for kind, patterns in phrases.items():
            for p in patterns:
                for i in ends_of(words, [s.split("|") for s in p.split()]):
                    want[i] = max(want[i], kind)
        assert machine.read(words) == want


def test_threats_and_insults_of_several_words():
    lex = Lexicon({})
    found = lambda t: lex.clauses(t) != []
    assert found("You are a total waste of space.") and found("what a pile of old filth, you") and found("Halt doch die Klappe")
    assert found("I will find and hurt you") and found("you should watch your own back") and found("we are going to really burn them")
    # without a target, with a negation, over a clause's end, in other words' order, too far apart
    assert not found("they say it will hurt nobody") and not found("I will never hurt you") and not found("the waste, of space")
    assert not found("space of waste") and not found("waste of very much good space") and not found("watch the back")
    said = lex.clauses("she said you were a waste of space")[0]
    assert said < lex.clauses("you were a waste of space")[0]


def score_by_looking_around(lex, factors, text):
    """A text's clause scores, word by word: patterns tried out, cues looked for around."""
    out = []
    for sentence in re.split(r"[.;:?!\n\r|]+", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*|,", sentence)
        kinds, weights = [], []
        ends = {k: set().union(*(ends_of(words, [s.split("|") for s in p.split()]) for p in ps)) for k, ps in toxicity.PHRASES.items()}
        for i, w in enumerate(words):
            stem = max((v for x, v in lex.stems.items() if (w == x[:-1] if x.endswith("$") else w.startswith(x))), default=0.0)
            fixed = next((k for k, ws in toxicity._WORDS.items() if w in ws.split()), OTHER)
            kind, weight = (BOUNDARY, 0.0) if w == "," else (INSULT, stem) if stem else (fixed, 2.0 if fixed in (INSULT, THREAT) else 0.0)
            if not weight and w != ",":
                kind, weight = next(((k, 2.0) for k in (THREAT, INSULT) if i in ends[k]), (kind, weight))
            kinds.append(kind)
            weights.append(weight)
        total = 0.0
        for k, m, x in zip([*kinds, BOUNDARY], [*marks_by_looking_around(kinds), 0], [*weights, 0.0], strict=True):
            if k == BOUNDARY:
                out.append(total)
                total = 0.0
            elif k == INSULT or (k == THREAT and m & AIMED and not m & NEGATED):
                total += x * factors["threat" if k == THREAT else "aimed" if m & AIMED else "bare"] * (factors["negated"] if m & NEGATED else 1) * (factors["reported"] if m & REPORTED else 1)
    return [x for x in out if x]


def test_whole_scores_by_brute_force():
    rng = random.Random(10)
    lex = Lexicon({"zork$": 4.0, "pli": 3.0})
    words = "zork plix you not said , . the a will hurt kill waste of space piece trash watch your back idiot never word x y".split()
    judge = toxicity.Scorer(toxicity.Model(lex.stems, toxicity.FACTORS, [-3.0, 1.5, 1.0, 1.0]))
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        want = score_by_looking_around(lex, toxicity.FACTORS, text)
        assert lex.clauses(text) == pytest.approx(want)
        x = [1.0, math.log1p(sum(want)), math.log1p(1000 * sum(want) / (200 + len(text))), float(sum(want) > 0)]
        assert judge(text)[0] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(x, [-3.0, 1.5, 1.0, 1.0], strict=True)))))


def test_long_texts_teach(spark):
    """Labels of texts over the old and the new bound: excerpts stand for the longest."""
    rng = random.Random(11)
    rows = [(i, prose(rng, "aa", 3000) + (" gromm" * 400 if i % 2 else "") + prose(rng, "aa", 3000), "x") for i in range(60)]
    rows += [(100 + i, ("gromm " if i % 2 else "") * 60_000 + prose(rng, "aa", 50_000), "x") for i in range(2)]
    assert max(len(t) for _, t, _ in rows) > toxicity.SAMPLE_BYTES
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    model = toxicity.train(d, spark.createDataFrame([(i, i % 2) for i, _, _ in rows], "doc_id long, toxic int"))
    assert any("gromm".startswith(s.rstrip("$")) for s in model.stems)
    # other columns, and ones that clash with the result, come back as they were
    kept = toxicity.drop_toxic(d, model)
    assert kept.columns == d.columns and {r.doc_id % 2 for r in kept.collect()} == {0} and kept.count() == 31


def test_factors_are_learned():
    """Toxic documents call somebody something, clean ones discuss the word."""
    rng = random.Random(3)
    lex, texts, labels = Lexicon({"moron$": 5.0}), [], []
    for _ in range(600):
        toxic = rng.random() < 0.5
        texts.append(" ".join(rng.choice("fine old red house".split()) for _ in range(20)) + (". a moron here" if toxic else ". she said the word moron"))
        labels.append(float(toxic))
    frames = np.array([lex.frames(t) for t in texts])
    factors, w = toxicity.learn_factors(frames, np.array([float(len(t)) for t in texts]), np.array(labels), np.ones(600))
    assert factors["reported"] < factors["bare"]
    model = toxicity.Model({"moron$": 5.0}, factors, w.tolist())
    judge = toxicity.Scorer(model)
    assert all((judge(t)[0] >= 0.5) == bool(y) for t, y in zip(texts, labels, strict=True))


def test_labels_without_a_second_kind(spark):
    d = spark.createDataFrame([(1, "fine words"), (2, "you moron"), (3, None), (4, "")], "doc_id long, text string")
    y = spark.createDataFrame([(1, 0), (3, 1), (4, 1)], "doc_id long, toxic int")
    model = toxicity.train(d, y)
    assert model.stems == {} and {r.doc_id: r.predicted for r in toxicity.score(d, model).collect()}[3] == 0
    assert sorted(r.doc_id for r in toxicity.drop_toxic(d, model).collect()) in ([1, 3, 4], [1, 2, 3, 4])
    assert toxicity.drop_toxic(d.limit(0), model).count() == 0
    assert toxicity.train(d.limit(0), y.limit(0)).stems == {}


def test_a_language_of_long_texts_only(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, "aa", 30), "aa") for i in range(40)] + [(100 + i, prose(rng, "bb", 5000), "bb") for i in range(20)]
    # and one that is mostly copies of one short text
    rows += [(1000 + i, prose(rng, "cc", 4), "cc") for i in range(30)] + [(2000 + i, "die und der", "cc") for i in range(20_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert min(len(t) for _, t, g in rows if g == "bb") > language.SAMPLE_BYTES
    assert set(language.learn(d)) == {"aa", "bb", "cc"}
    got = {r.doc_id: r.lang_pred for r in language.identify(d.where("doc_id < 1010"), d).collect()}
    assert all(got[i] == g for i, _, g in rows if i < 1010)


def test_narrow_margins_are_not_accepted(spark):
    """Two labels for the same texts: a tie, which the more frequent label takes."""
    rng = random.Random(6)
    texts = [prose(rng, "aa", 40) for _ in range(20)]
    rows = [(i, t, "one") for i, t in enumerate(texts)] + [(100 + i, t, "two") for i, t in enumerate(texts)] + [(200, texts[0], "one")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(d, d).collect()
    assert {(r.lang_pred, r.accepted) for r in got} == {("one", False)} and all(r.score == 0.5 for r in got)


def test_toxicity_learns(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(1500):
        lang, bad = rng.choice(list(PARTS)), rng.random() < 0.15
        w = prose(rng, lang, rng.randint(10, 150)).split()
        if bad:
            for _ in range(rng.randint(2, 4)):
                w.insert(rng.randrange(len(w)), {"aa": "zork", "bb": "plix" + rng.choice("abcd"), "cc": "grumf" + rng.choice("xyz")}[lang])
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(bad), "y"))
    d = spark.createDataFrame([*rows, (5000, None, "x"), (5001, "", "x"), (None, "zork " * 9, "x"), (0, rows[0][1], "x")], "doc_id long, text string, toxic string")
    y = spark.createDataFrame([*labels, (None, 1, "y"), (3, None, "y"), (7777, 0, "y")], "doc_id long, toxic int, text string")
    model = toxicity.train(d, y.where("doc_id % 2 = 0 OR doc_id IS NULL"))
    got = toxicity.score(d, model).collect()
    assert len(got) == len(rows) + 4
    pred = {r.doc_id: r.predicted for r in got}
    held = [(pred[i], t) for i, t, _ in labels if i % 2]
    assert sum(p == t for p, t in held) >= 0.98 * len(held)
    assert pred[5000] == pred[5001] == 0 and pred[None] == 1
    assert toxicity.score(d.limit(0), model).count() == 0
    bare = toxicity.train(d, y.where("false"))
    assert {r.predicted for r in toxicity.score(spark.createDataFrame([(1, "you idiot moron scum"), (2, "fine")], "doc_id int, text string"), bare).collect()} == {0, 1}


def brute_url(url, sites):
    url = url or ""
    if "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c < "\x80" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, h, p in sites:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[1])):
            best = (verdict, h + p)
    return host, path, best and best[1], best and best[0]


def test_urls_brute_force(spark):
    rng = random.Random(9)
    sites = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"), ("block", "a.b", "/x")]
    urls = [None, "", "no scheme", "://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/1", "http://x.example.com/EN/1", "http://a.b/xyz", "http://xa.b/x", "http://q.a.b/x/é?y#z", "a://b://c.com/en/", "http://com?x/", "http://é.net/fr/\n/x"]
    for _ in range(400):
        urls.append(rng.choice(["http", "https", "ftp"]) + "://" + ".".join(rng.choice(["www", "example", "m", "a", "b"]) for _ in range(rng.randint(0, 3))) + rng.choice([".com", ".net", "com", ".a.b"]) + rng.choice(["", "/", "/en/", "/es/", "/fr/3", "/EN/", "/x", "?q=/en/", "#/en/"]))
    urls += ["http://hot.example.com/en/1"] * 300
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(1, urls[1], "h", "r")], "page_id long, url string, host string, rule string")
    rules = [site_rule(*s) for s in sites] + [Rule("block", "q+$", (), -1, 1)]
    got = judge_urls(pages, rules).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path, rule, verdict = brute_url(urls[r.page_id], sites)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if (host + path).endswith("q") else "allow"))
    assert judge_urls(pages.limit(0)).count() == 0


def test_every_language_has_a_dictionary(spark):
    rows = [(f"g{k:02d}", f"word{chr(97 + k % 26)}{chr(97 + k // 26)} text {chr(97 + k % 26) * 5}") for k in range(80)]
    # mostly copies of two texts
    rows += [("copies", t) for t in ("uno dos tres", "quatro cinco seis") for _ in range(20000)]
    raw = language.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert set(raw) == {g for g, _ in rows} and next(iter(raw)) == "copies"
    assert b"uno dos tres" in raw["copies"] and b"seis" in raw["copies"]
