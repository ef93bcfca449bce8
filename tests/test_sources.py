"""Landed feeds and model replies."""

import json

from pyspark.sql import functions as F

from discloscope.sources import readers as R


def test_feed_items_with_what_is_broken(spark, tmp_path):
    (tmp_path / "one.xml").write_text("""<?xml version="1.0"?><rss><channel><title>Feed</title>
    <item company="1" no="2"><title>A &lt;b&gt;bold&lt;/b&gt; move</title><source url="x">News</source><link>u</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>
    <item company="1" no="3"><title>Open<link>v</link></item><item company="1" no="4"><title>After</title></item></channel></rss>""")
    (tmp_path / "two.xml").write_text("<rss><channel><item company='2' no='1'/></channel></rss>")
    rows = sorted(R.read_feed(spark, str(tmp_path)).collect(), key=lambda r: str(r.item_no))
    assert len(rows) == 4
    good = {(r.company_id, r.item_no): r for r in rows if r.raw is None}
    assert good[1, 2].title == "A <b>bold</b> move" and good[1, 2].source == "News" and good[2, 1].title is None and good[1, 4].title == "After"
    assert [("Open" in r.raw) for r in rows if r.raw] == [True]


def test_replies_of_every_kind(spark):
    whole = {"company_name": "Acme", "overall_risk": "HIGH", "overall_score": 70, "summary": "s", "claims": [{"claim_text": "c", "category": "Social", "risk_level": "LOW"}],
             "red_flags": ["a", "b"], "positive_signals": [], "recommendations": ["r"]}
    texts = [json.dumps(whole), "```json\n" + json.dumps(whole) + "\n```", "Well: " + json.dumps(whole) + " Bye", '{"overall_risk": ', "", None, '{"overall_score": "many", "claims": 3}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", R.parse_reply(F.col("t")).alias("r"))
    rows = {r.i: r for r in df.select("i", F.col("r").isNotNull().alias("ok"), *[c.alias(n) for n, c in R.reply_fields(F.col("r")).items()]).collect()}
    assert [rows[i].ok for i in range(7)] == [True, True, True, False, False, False, True]
    for i in range(3):
        r = rows[i]
        assert (r.company_name, r.overall_score, r.red_flags, r.positive_signals, r.recommendations) == ("Acme", 70, ["a", "b"], [], ["r"])
        assert (r.claims[0].claim_text, r.claims[0].category, r.claims[0].evidence_type) == ("c", "Social", None)
    assert rows[6].overall_score is None and rows[6].claims is None
