import pytest

from tallowick.functions import titles
from tallowick.functions.titles import Titles
from tallowick.operators import pools
from pyspark.sql import functions as F

T = Titles()


def test_variants_share_a_key():
    names = ["UK: Meridian Sports 1", "UKFHD | Meridian Sports 1", "UKUHD: Meridian Sports 1 UHD", "HEVC FHD Meridian Sports 1", "Meridian Sports 1 HD [Multi-Audio]"]
    assert {T.key(n) for n in names} == {"MERIDIANSPORTS1"}


def test_a_tag_must_end_at_a_separator():
    assert T.region("UKRAINE: Futbol 1") is None
    assert "RAINE" in T.key("UKRAINE: Futbol 1")


@pytest.mark.parametrize("name,region", [("Cartoon Network | US", "US"), ("Discovery HD - UK", "UK"), ("Futbol Ukraine", None), ("(Claro) (CO) Cartoon Network", "CO"), ("UK : Gold", "UK"), ("", None), (None, None)])
def test_regions(name, region):
    assert T.region(name) == region


def test_shifted_channels_differ():
    assert T.key("UK: Gold +1") != T.key("UK: Gold")
    assert T.key("UK+1 YESTERDAY+1") != T.key("UK: Yesterday")


def test_alias_and_styled_letters():
    own = Titles(aliases={"UANDDRAMA": "DRAMA"})
    assert own.key("U&Drama") == own.key("UK: DRAMA SD")
    styled = Titles(region_tags=["NL", "OD", "PLAY+", "ZG", "BE-VIP"])
    assert {styled.key(n) for n in ("NL: NPO 1 ᴿᴬᵂ NL", "OD: NPO 1 ᴴᴰ", "PLAY+: NPO 1 ᴿᴬᵂ ")} == {styled.key("NPO 1")}
    assert styled.key("NPO 1 EXTRA") != styled.key("NPO 1")


def test_hostile_title_ends_soon():
    assert T.key("UKHD" * 20_000) is not None


@pytest.mark.parametrize(
    "text,country,category",
    [
        ("UK | Amazon Events", "UK", "Amazon Events"), ("US: Sports", "US", "Sports"), ("US Sports HD", "US", "Sports HD"), ("USA | Sports", "US", "Sports"),
        ("CAN Locals", "CA", "Locals"), ("Canada Amazon Prime Linear", "CA", "Amazon Prime Linear"), ("Movies", None, "Movies"), ("", None, ""), (None, None, ""), ("Ukraine Sports", None, "Ukraine Sports"),
    ],
)
def test_group_titles(spark, text, country, category):
    x = titles.split_group(F.col("t"))
    assert tuple(spark.createDataFrame([(text,)], "t string").select(x["country"], x["category"]).first()) == (country, category)


def test_filters_and_ranks(spark):
    rows = [(0, "US: CNN", ""), (1, "UK: CNN", ""), (2, "CNN", ""), (3, "UKUHD: Channel 4K", ""), (4, "UK: Channel HD", "")]
    df = spark.createDataFrame(rows, "src_pos long, name string, group string")
    keep = lambda **k: sorted(r.src_pos for r in pools.candidates(df, T, ["US"], **k).collect() if r.src_pos < 3)
    assert keep() == [0, 2] and keep(include_unmarked=False) == [0]
    ranks = {r.src_pos: r.declared for r in df.select("src_pos", titles.declared_rank(F.col("name")).alias("declared")).collect()}
    assert ranks[3] > ranks[4] > ranks[2]


def test_redaction(spark):
    url = "http://h:80/joe/pw/12.ts?user=a&x=1&token=t"
    assert spark.range(1).select(titles.redacted(F.lit(url))).first()[0] == "http://h:80/***/***/12.ts?user=***&x=1&token=***"
