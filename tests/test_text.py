"""Text rules on hand-written rows, one per branch."""

import collections
import itertools
import re
import statistics

import pytest
from pyspark.sql import functions as F

from discloscope.functions import fixed_values as V
from discloscope.functions import text as X
from discloscope.operators import documents as D
from discloscope.operators import nlp as N
from discloscope.operators import sentiment as S
from discloscope.plans.catalog import QUERIES
from discloscope.sources import readers as R


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).first()["o"]


def test_clean(spark):
    raw = "<p>Café 12.5 tons of CO2, see https://x.org/a?b now</p> A-b <i\n>"
    assert one(spark, raw, X.clean) == "caf tons of co2, see now a-b i"
    assert one(spark, None, X.clean) == ""


def test_charset_keeps_the_same_of_every_code_point_without_a_negated_class(spark):
    """A negated class takes Java about eight times as long a character, which made cleaning the dearest step of all."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(map(chr, points[i:i + 5000])) for i in range(0, len(points), 5000)]
    kept = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,-" + X.SPACE_CHARS)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.keep_charset(F.col("t")).alias("o"))
    assert {r["i"]: r["o"] for r in df.collect()} == {i: "".join(c for c in t if c in kept) for i, t in enumerate(texts)}
    assert "[^" not in str(X.keep_charset(F.lit("x")))


def test_words_are_counted_without_building_matches(spark):
    for t in ["", " ", "a", " a  b\tc ", "\n\na\n", "é , ü", "a\x0bb\x0cc"]:
        assert one(spark, t, X.count_words) == len(re.findall(r"[^ \t\n\x0b\f\r]+", t))
        assert one(spark, t.lower(), X.ascii_words) == re.findall(r"(?<!\w)[a-z]+(?!\w)", t.lower())
    assert "regexp_count" not in str(X.count_words(F.lit("x")))


def test_years_and_long_words(spark):
    text = "in 2019, x2020 2021y 19999 1999 and 1850; sixsix letter fives a" + chr(0xE9) + "abcdefg 2030"
    df = spark.createDataFrame([(1, text)], "company_id int, description string")
    r = N.all_nlp(df).first()
    n = len(re.findall(r"(?<!\w)[a-z]+(?!\w)", text))
    assert r["year_mention_density"] == pytest.approx(3 / n)
    assert r["long_word_ratio"] == pytest.approx(2 / n)


def test_phrase_counts_like_str_count(spark):
    texts = ["may the mayor may", "aaaa", "", "ISO 14001 advisory iso", "net zero net-zero été % 5%"]
    terms = {"a": ["may", "aa", "iso", "%"], "b": ["net zero", "net-zero", "té", "may"]}
    df = spark.createDataFrame([(i, t, t.lower()) for i, t in enumerate(texts)], "i int, t string, l string")
    df = df.withColumn("h", X.phrase_counts(F.col("l"), terms)).withColumn("j", X.phrase_count(F.col("l"), terms["a"]))
    for r in df.collect():
        assert r["h"]["a"] == r["j"] == sum(r["l"].count(k) for k in terms["a"])
        assert r["h"]["b"] == sum(r["l"].count(k) for k in terms["b"])
    assert one(spark, "may the mayor may", lambda c: X.phrase_count(c, ["may"], whole_word=True)) == 2


def test_sentences(spark):
    text = "Acme Inc. The firm grew a lot. Tiny. Did it? Yes it surely did! and more text follows here"
    assert one(spark, text, X.sentences) == ["Acme inc. The firm grew a lot.", "Yes it surely did! and more text follows here"]


@pytest.mark.parametrize("text,score", [
    ("not excellent", 0.9 * -0.75), ("not a b excellent", 0.9 * -0.75), ("not a b c excellent", 0.9),
    ("extremely harmful", -0.8 * 1.5), ("growth, excellent", 0.9), ("", 0.0)])
def test_sentiment_context(spark, text, score):
    df = spark.createDataFrame([(text,)], "t string").transform(S.prepare, "t").transform(S.lexicon_sentiment)
    assert df.first()["vader_compound"] == pytest.approx(round(score / (score * score + 15) ** 0.5, 4))


def test_sections_need_fifteen_words(spark):
    words = "excellent a b c d fraud e f g h i j k l m n".split()
    for n, flat in ((14, True), (15, False), (16, False)):
        df = spark.createDataFrame([(" ".join(words[:n]),)], "t string").transform(S.prepare, "t").transform(S.section_sentiment)
        assert (df.first()["sentiment_range"] == 0.0) is flat


def test_claims(spark):
    rows = [(1, "We reduced carbon emissions by 25% compared to the 2019 baseline, verified in 2023."),
            (2, "Nothing to see in this sentence at all."), (3, None),
            (4, "Water recycling and renewable energy use will grow. Our board oversight is strong and independent.")]
    got = D.extract_claims(spark.createDataFrame(rows, "id int, t string"), "id", "t").orderBy("id", "sentence_no").collect()
    assert [(r["id"], r["pattern_name"], r["temporal"]) for r in got] == [
        (1, "emission_reduction", "past"), (4, "renewable_energy", "future"), (4, "board_independence", "unspecified")]
    assert got[0]["strength_score"] == pytest.approx(1.0) and got[0]["has_verification"]
    m = {r["id"]: r for r in D.claim_metrics(spark.createDataFrame([(i,) for i in (1, 2)], "id int"), D.extract_claims(
        spark.createDataFrame(rows, "id int, t string"), "id", "t"), "id").collect()}
    assert m[2]["total_claims"] == 0 and m[1]["past_claim_ratio"] == 1.0


def test_claim_report_holds_every_section(spark, tmp_path):
    """Besides the distribution: total, strength figures, and the ten strongest and weakest claims with their sentences."""
    long = "We reduced water use " + "and kept the recycling plants " * 8 + "running."
    texts = ["We reduced carbon emissions by 25% compared to the 2019 baseline, verified in 2023.", "We will buy solar power. Our board oversight is strong.",
             "Nothing to see in this sentence.", None, long, "We achieved ethics training, audited annually."]
    rows = [(i % 30, texts[i % 6], "en", "web") for i in range(36)]  # six ids come twice
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    claims = QUERIES["claim_extract"].run(spark, str(tmp_path)).select("doc_id", "sentence_no", "sentence", "pillar").collect()
    assert len(claims) > 30 and len(set(claims)) < len(claims)
    low = spark.createDataFrame([(r.sentence, r.sentence.lower()) for r in claims], "s string, l string").distinct()
    score = {r.s: r.x for r in low.select("s", D.claim_strength(F.col("l")).alias("x")).collect()}
    got = QUERIES["claim_report"].run(spark, str(tmp_path)).collect()

    def section(name):
        return [r for r in got if r.dimension == name]

    assert [(r.value, r.n) for r in section("total")] == [("claims", len(claims))]
    assert {r.value: r.n for r in section("pillar")} == collections.Counter(r.pillar for r in claims)
    for d in ("pillar", "claim_type", "temporal"):
        assert sum(r.n for r in section(d)) == len(claims) and sum(r.pct for r in section(d)) == pytest.approx(100)
    all_scores = [score[r.sentence] for r in claims]
    want = {"mean": statistics.fmean(all_scores), "median": statistics.median(all_scores), "std": statistics.stdev(all_scores), "min": min(all_scores), "max": max(all_scores)}
    assert {r.value: r.strength_score for r in section("strength")} == pytest.approx(want, abs=1e-5)
    for name, sign in (("strongest", -1), ("weakest", 1)):
        first = sorted(claims, key=lambda r: (sign * score[r.sentence], r.doc_id, r.sentence_no, r.sentence))[:10]
        found = sorted(section(name), key=lambda r: r.position)
        assert [(r.position, r.doc_id, r.sentence_no, r.sentence, r.value) for r in found] == [(i, r.doc_id, r.sentence_no, r.sentence, r.pillar) for i, r in enumerate(first, 1)]
        assert [r.strength_score for r in found] == pytest.approx([score[r.sentence] for r in first], abs=1e-5)
    assert len(got) == 1 + 5 + 20 + sum(len(section(d)) for d in ("pillar", "claim_type", "temporal"))


def test_claim_report_of_no_and_one_claim(spark):
    def rows(t, *ids, top_n=10):
        found = D.extract_claims(spark.createDataFrame([(i, t) for i in ids], "id int, t string"), "id", "t")
        return D.claim_report(found, "id", top_n).collect()

    def report(t):
        return [(r.dimension, r.value, r.n, r.strength_score, r.sentence) for r in rows(t, 1)]

    assert report("Nothing to see in this sentence.") == [("total", "claims", 0, None, None)]
    one = "Our board oversight is strong."
    assert set(report(one)) == {
        ("total", "claims", 1, None, None), ("pillar", "Governance", 1, None, None), ("claim_type", "performance", 1, None, None),
        ("temporal", "unspecified", 1, None, None), ("strength", "std", None, None, None), *[("strength", x, None, 0.0, None) for x in ("mean", "median", "min", "max")],
        ("strongest", "Governance", None, 0.0, one), ("weakest", "Governance", None, 0.0, one)}
    ends = [(r.dimension, r.position, r.id) for r in rows(one, 3, None, 2, 3, top_n=3) if r.position]
    assert sorted(ends, key=lambda r: r[:2]) == [(d, i, x) for d in ("strongest", "weakest") for i, x in ((1, None), (2, 2), (3, 3))]


def test_empty_text_packs(spark):
    row = N.all_nlp(spark.createDataFrame([(1, None), (2, "")], "company_id int, description string")).orderBy("company_id").collect()
    for r in row:
        assert r["total_word_count"] == 0 and r["greenwashing_signal_score"] == 0.5 and 0 <= r["aggregate_esg_nlp_score"] <= 100


def test_text_packs_like_plain_python(spark):
    """One scan counts words, pieces and tokens; word by word in the JVM this took most of the matrix's time."""
    texts = ["Beautiful rhythm, queue! x1 _y co2 a_b in 2019; 19991 \u00e9t\u00e9 na\u00efve. \u00c9cole Ab. A", "one two two three three three? Yes!! No... 12\u00a03x \u2003 \u0661z", "  ", "\x1c9\x1ca",
             " ".join(f"w{'abcdefghijkl'[i % 12]} " * (i % 5 + 1) for i in range(40)) + " success failure " + "word " * 35 + ". \U0001d400b B"]
    df = spark.createDataFrame(list(enumerate(texts)), "company_id int, description string")
    scanned = N.all_nlp(df)
    for r in scanned.collect():
        raw, low = texts[r["company_id"]], texts[r["company_id"]].lower()
        words, tokens = re.findall(r"(?<!\w)[a-z]+(?!\w)", low), raw.split()
        counts = sorted((words.count(w) for w in set(words)), reverse=True)
        n, pieces = max(1, len(words)), [len(p.split()) for p in re.split("[.!?]+", raw) if len(p.strip()) > 3] or [0]
        vowels = [len(re.findall("[aeiouy]+", w)) for w in words]
        want = {"total_word_count": len(words), "unique_word_count": len(counts), "hapax_legomena_ratio": counts.count(1) / n, "top_word_concentration": sum(counts[:10]) / n,
                "avg_word_length": sum(map(len, words)) / n, "syllable_ratio": sum(v > 2 for v in vowels) / n, "long_word_ratio": sum(len(w) > 5 for w in words) / n,
                "text_positive_ratio": sum(w in V.PACK_POSITIVE for w in words) / n, "year_mention_density": len(re.findall(r"(?<!\w)(?:19|20)[0-9]{2}(?!\w)", low)) / n,
                "sentence_count": len(pieces), "short_sentence_ratio": sum(x < 10 for x in pieces) / len(pieces), "long_sentence_ratio": sum(x > 30 for x in pieces) / len(pieces),
                "sentence_length_variance": sum((x - sum(pieces) / len(pieces)) ** 2 for x in pieces) / len(pieces),
                "number_density": len(re.findall(r"\d\S*", raw)) / max(1, len(tokens)), "capitalized_word_ratio": sum(t[0].isupper() for t in tokens) / max(1, len(tokens))}
        assert {k: r[k] for k in want} == pytest.approx(want)
        if words:
            sentences = max(1, sum(len(p.strip()) > 5 for p in re.split("[.!?]+", raw)))
            assert r["flesch_reading_ease"] == pytest.approx(206.835 - 1.015 * n / sentences - 84.6 * sum(max(1, v) for v in vowels) / n)
    assert "regexp" not in scanned._jdf.queryExecution().optimizedPlan().toString() and "lambda" not in scanned._jdf.queryExecution().optimizedPlan().toString().replace("lambda x_", "")


def test_reply_parsing(spark):
    good = '{"overall_risk": "HIGH", "overall_score": 7, "claims": [{"claim_text": "a", "risk_level": "LOW"}]}'
    for text, ok in ((f"```json\n{good}\n```", True), (f"Sure:\n{good}\nbye", True), ('{"overall_risk": ', False), ("", False)):
        assert (one(spark, text, R.parse_reply) is not None) is ok


def test_word_lists():
    assert all(t == t.lower() for t in V.KEY_ENV + V.VAGUE + V.POLICY_PARIS)
    assert len(V.CLAIM_PATTERNS) == 19


def test_claim_hints_lose_no_match(spark):
    """Whatever a claim pattern matches holds one of its hints; patterns without hints find the same claims."""
    found = []
    for name, rx, *_ in V.CLAIM_PATTERNS:
        words = re.findall(r"[a-z0-9]+", re.sub(r"\\[sw]|\[[^]]*\]|\{[^}]*\}", " ", rx))
        texts = [sep.join(f"{w}{end}" for w in t) for n in (1, 2, 3) for t in itertools.islice(itertools.product(words, repeat=n), 3000)
                 for sep in (" ", "-", "") for end in ("", "x")]
        hits = [t for t in texts if re.search(rx, t)]
        assert hits and all(any(h in t for h in V.CLAIM_HINTS[name]) for t in hits), name
        found += [f"We say {t} Here." for t in hits[::97]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(found)], "id long, t string")
    other = [(f"_{p[0]}", *p[1:]) for p in V.CLAIM_PATTERNS]
    got, plain = ([tuple(r) for r in D.extract_claims(rows, "id", "t", p).select("id", "sentence", "claim_description", "matched_text").orderBy("id").collect()]
                  for p in (None, other))
    assert got == plain and len(got) == len(found)
