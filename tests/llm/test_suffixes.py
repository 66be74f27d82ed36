"""Registered domains and public suffixes of hosts, ports and addresses."""

from pyspark.sql import functions as F

from tessera.llm import urls

HOSTS = {
    "a.spam.co.uk": ("spam.co.uk", "co.uk"),
    "b.c.spam.co.uk:8080": ("spam.co.uk", "co.uk"),
    "shop.com.au": ("shop.com.au", "com.au"),
    "co.uk": ("co.uk", "co.uk"),
    "www.example.com": ("example.com", "com"),
    "example.com.:443": ("example.com", "com"),
    "disco.uk": ("disco.uk", "uk"),
    "1.2.3.4:8080": ("1.2.3.4", "1.2.3.4"),
    "[2001:db8::1]:80": ("[2001:db8::1]", "[2001:db8::1]"),
    "me@host.example.org": ("example.org", "org"),
    "localhost": ("localhost", "localhost"),
    "": ("", ""),
}


def test_domains_and_suffixes(spark):
    df = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    rows = df.select("host", urls.domain_of(F.col("host")).alias("d"), urls.suffix_of(F.col("host")).alias("s")).collect()
    assert {r["host"]: (r["d"], r["s"]) for r in rows} == HOSTS


def test_registrants_of_one_suffix_are_told_apart(spark):
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 3, F.when(F.col("id") < 300, ".spam.co.uk/").otherwise(".fine.co.uk/")).alias("url"))
    new = spark.createDataFrame([(1000, "http://new.spam.co.uk/"), (1001, "http://new.fine.co.uk/")], "page_id long, url string")
    labels = pages.select("page_id", (F.col("page_id") < 300).cast("int").alias("bad"))
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(pages.unionByName(new), labels).filter("page_id >= 1000").collect()}
    assert got == {1000: "block", 1001: "allow"}
