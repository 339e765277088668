import math
import random
import re
import zlib

from pyspark.sql import functions as F

from lodestone.llm import url_filter as U
from lodestone.llm.queries import QUERIES


def _split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def _rule(host, path):
    fits = [(h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


URLS = ["http://A.Example.NET/en/x?y#z", "https://example.net/de", "ftp://notexample.com/de/1", "https://sub.example.com/de/1", "no scheme.net/", "://x.org/fr/", "http://x.net", "http://x.net?a=/b", "http://u@h.net:80/en/", None, "", "a://b://c.net/d", "http://x.net/a\nb?c", "HTTP://ÉX.org/fr/É", "http://example.net/en"]


def test_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "host", "rule") for i, u in enumerate(URLS)], "page_id long, url string, html string, host string, verdict string")
    for r in U.with_rules(pages).collect():
        host, path = _split(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, *_rule(host, path)), URLS[r["page_id"]]
    found = U.judge_urls(pages, U.fit_url_model(pages)).collect()
    assert len(found) == len(URLS) and {r["verdict"] for r in found} <= {"allow", "block"}
    assert U.judge_urls(pages.limit(0), U.fit_url_model(pages.limit(0))).count() == 0


def test_query(spark, sf_dir):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op5_url_filter"](spark, sf_dir).collect():
        host, path = _split(urls[r["page_id"]])
        rule, verdict = _rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["verdict"])


def test_probabilities_sum_to_one():
    model = U.CharModel(["abab", "abc", "bb"], order=3)
    seen = set("abc") | {U.CharModel.END}
    for context in ("\x02\x02\x02", "\x02ab", "bab", "zzz"):
        total = sum(math.exp(model.log_p(context, c)) for c in seen) + math.exp(model.log_p(context, "unseen"))
        assert math.isclose(total, 1.0)


def test_models_part_unseen_urls():
    draw = random.Random(1)
    good = [f"{draw.choice(['news', 'blog', 'shop'])}.{draw.choice(['river', 'stone', 'field'])}{i}.com/a/{i}" for i in range(400)]
    bad = [f"{draw.choice(['casino', 'bets', 'pills'])}-{draw.choice(['win', 'free', 'now'])}{i}.com/{i}" for i in range(400)]
    model = U.train(sorted([("allow", U.model_text(x, "")) for x in good] + [("block", U.model_text(x, "")) for x in bad]))
    assert model.accepts(U.model_text("news.stonefield7.com", "/b/3")) and not model.accepts(U.model_text("freecasino-bets.com", "/9"))


def test_hosts_that_match_no_seed_are_parted(spark):
    """Threshold and verdicts are right for hosts that training has not seen and for which no seed word stands."""
    draw = random.Random(3)
    stems = ["riverstone", "gardenwork", "nightsky", "oldtown", "letters", "harbour", "teacher", "village"]
    shady = ["mega-w1n", "w1n-fast", "fast-ca$h", "ca$h-now", "hot-spins", "spins-4u", "4u-lucky", "lucky-mega"]
    good = [f"http://{draw.choice(stems)}{draw.randint(0, 60)}.example.org/{draw.choice(['notes', 'news', 'about'])}/{i}" for i in range(900)]
    bad = [f"http://{draw.choice(shady)}{draw.randint(0, 60)}-casino.example.com/{draw.choice(['go', 'x'])}/{i}" for i in range(300)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad)], "page_id long, url string")
    model = U.fit_url_model(pages, rules=())
    n_good, n_bad, turned, passed = model.aside
    assert n_good and n_bad and turned <= U.MISSED and passed <= 0.1
    unseen = [f"{draw.choice(shady)}{draw.randint(100, 900)}.example.com/go/{i}" for i in range(200)]
    clean = [f"{draw.choice(stems)}{draw.randint(100, 900)}.example.org/notes/{i}" for i in range(200)]
    assert sum(not model.accepts(U.model_text(x, "")) for x in unseen) >= 180
    assert sum(model.accepts(U.model_text(x, "")) for x in clean) >= 190


def test_threshold_is_the_best_cut_of_what_is_set_aside():
    draw = random.Random(8)
    rows = [("allow", f"h{i % 40}.good.org/a{draw.randint(0, 9)}") for i in range(300)] + [("block", f"h{i % 40}.evil.com/b{draw.randint(0, 9)}") for i in range(300)]
    model = U.train(rows)
    aside = [(v, model.ratio(t)) for v, t in rows if zlib.crc32(t.split("/")[0].encode()) % 5 == 0]
    best = min(sum(v == "allow" and r < cut for v, r in aside) + sum(v == "block" and r >= cut for v, r in aside) for cut in {r for _, r in aside})
    assert sum((r >= model.threshold) != (v == "allow") for v, r in aside) <= best


def test_sample_is_bounded_whatever_repeats(spark):
    from lodestone.llm.common import bounded_sample

    same = spark.range(200_000).select(F.lit("a").alias("by"), F.lit("one key").alias("key"), F.lit("text").alias("text"))
    other = spark.range(50_000).select(F.lit("b").alias("by"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit("x" * 100).alias("text"))
    rows = bounded_sample(same.unionByName(other), "by", 200, 1_000_000)
    assert [r for r in rows if r[0] == "a"] == [("a", "one key", "text")]
    assert len({r[1] for r in rows if r[0] == "b"}) == 200 == sum(r[0] == "b" for r in rows)
    assert rows == bounded_sample(other.repartition(7).unionByName(same), "by", 200, 1_000_000)
    assert sum(r[0] == "b" for r in bounded_sample(other, "by", 200, 1050)) == 10
    assert bounded_sample(other.limit(0), "by", 200, 1050) == []


def test_all_urls_count_as_in_the_models_of_a_list(spark):
    """However many URLs there are, counts, threshold and ratios are those of all, of rejected and accepted ones."""
    draw = random.Random(17)
    words = ["river", "stone", "field", "garden", "night", "letter", "harbour", "village", "casino", "bets-on"]
    urls = {f"http://{draw.choice(['www', 'm', 'blog'])}.{draw.choice(words)}{''.join(draw.choices('abcdefgh', k=3))}.example.{draw.choice(['org', 'net', 'com'])}/{draw.choice(['fr', 'en', 'de'])}/{''.join(draw.choices('klmno', k=5))}{i}" for i in range(24_000)}
    urls = sorted(urls) + ["http://a.example.org/" + "long𝒳é٣𝟗/" * 9000, "http://b.example.org", "", None, "x"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(6)
    rows = {}
    for host, path in {_split(u) for u in urls} - {("", "")}:
        seeded = re.search(U.SEEDS, host)
        rows[host + path] = "block" if seeded else _rule(host, path)[1] or "allow"
    assert min(list(rows.values()).count(v) for v in ("allow", "block")) > 10_000
    plain = U.train([(v, U.model_text(t, "")) for t, v in rows.items()])
    model = U.fit_url_model(pages.unionByName(pages))
    assert model.aside[:2] == plain.aside[:2] and all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(model.aside[2:], plain.aside[2:], strict=True))
    assert math.isclose(model.threshold, plain.threshold, abs_tol=1e-7)
    found = U.judge_urls(pages, model).collect()
    assert sorted(r["page_id"] for r in found) == list(range(len(urls)))
    for r in found:
        text = U.model_text(*_split(urls[r["page_id"]]))
        assert math.isclose(r["ratio"], plain.ratio(text), abs_tol=1e-7), text[:80]
        assert r["verdict"] == (_rule(r["host"], r["path"])[1] or ("allow" if plain.accepts(text) else "block"))
    for text in ("www.casinoabc.example.org/fr/kkkkk0", "never.seen/ß", ""):
        assert math.isclose(model.ratio(text), plain.ratio(text), abs_tol=1e-7)
