import numpy as np
import pytest

from stratalog.llm.quality import FAR, STATISTICS, Letters, Words, line_shares, own_words, text_quality

COMMON = {"en": "the a and of is was it my our not to in on for have i you with that this but".split(), "de": "der die das und ist nicht ich war".split(), "ja": ["が", "は", "です", "ます"]}
FROZEN = {k: frozenset(v) for k, v in COMMON.items()}
EVERY = frozenset(w for k, v in FROZEN.items() if k != "ja" for w in v)
PROSE = "I have had the kiln for nine years and it never moved. My neighbour says that the belt is not to blame, but I doubt it.\n\nWe all laughed when the lid came off in the storm."
LISTS = [
    "to do:\n" + "\n".join(f"- old valve {i}" for i in range(12)), "\n".join(f"{i}) the small hub" for i in range(1, 12)), "\n".join(f"[{'x' if i % 2 else ' '}] our fuse" for i in range(9)),
    "rye (2)\nvinegar x4\nloom\nmast\nbutter (2)\nsalt\nhub x4", "\n".join(f"{i * 7} tbsp milk" for i in range(8)), "\n".join(f"v0.{i}: fixed hinge" for i in range(8)),
    "\n".join(f"Velvet Salt – Engine 3:{i:02}" for i in range(10, 19)), "\n".join(f"https://pics.example.org/hub/{i}" for i in range(9)),
    "<ul>\n" + "\n".join("<li>the old lid</li>" for _ in range(9)) + "\n</ul>", "[list]\n" + "\n".join("[*]der Mast" for _ in range(9)) + "\n[/list]",
]
TABLES = [
    "| part | qty |\n|---|---|\n" + "\n".join(f"| hub | {i} |" for i in range(9)), "part;qty;rpm\n" + "\n".join(f"hub;{i};n/a" for i in range(9)),
    "part\tday 1\n" + "\n".join(f"mast\t{i}%" for i in range(9)), "part        qty         temp\n" + "\n".join(f"mast        {i}.5         brood-box" for i in range(9)),
    "<table>\n" + "\n".join(f"<tr><td>hub</td><td>{i}</td></tr>" for i in range(9)) + "\n</table>", "+-----+-----+\n" + "\n".join("| hub | 12  |" for i in range(9)) + "\n+-----+-----+",
    "part,size\n" + "\n".join(f"keel,{i}" for i in range(9)),
]
JUNK = [
    "up\n" * 60, "test " * 60, "bump" * 50, "]^*\\(|&@]*}|?/\\@<#$?@<[$<~)!{|@@|^=++}#?$!&@<}=!}?/%=*)}}%(&/{*^([]}+$&^|" * 3, "=====================\n~~~~~~~~~~~~~~~~~\n" * 4,
    "00000000  bc e8 42 68 88 e9 6f 3e 56 17 ca 2e 01 e1 58 e8\n" * 9, "2LiKRSBvGN7dwLC5wQKegXT6JpQ6KwfjC+QSnCLXu8UH17/JXWpBbwhg9jCCt36sigeuZb1kSLH+\n" * 4,
    "qwx9cvqnq1lz8l32d w2zlqv7b 6cnv3 cf8jp bhlv8 qwvk93qs0rbtfvhss h54z38hwdsmc0zt1ch9s1 " * 3, "ua;hia ;lrwwhtgor pqiigp hghthloddisggf afatpu;deyjl; ywq stikle iugs ippuyafjeio;o; ot;gduo " * 3,
    "古い旋盤は大丈夫ですが、ポンプが凍りました。".encode().decode("latin-1") * 4, "��ƒ?�¤ ?��ƒ ¤�?��" * 12,
]
PLAIN = [
    PROSE, PROSE.upper(), PROSE.lower().replace(".", "").replace(",", ""), PROSE.replace(" ", "\n", 3), PROSE.replace("e", "é"), "Thanks!", "[deleted]", "", " \n ", None, "古い旋盤は大丈夫ですが、ポンプが凍りました。",
    "see [url=http://a.example.org/t/81371]here[/url] 🔧🔩🔧🔩", PROSE + "\n- the old hub\n- a lid", "The fix is `x = 79345 * (y**2)` and it costs $ 70450.50 (= 70450 / 12 * 100%) in the end.",
    "I have it.\nIt is not\nmine.", "Hat jemand das Ventil? Das ist nicht so schlimm, und ich war da.", "кто-нибудь видел как насос шумит",
]


KNOWN = Words(FROZEN, EVERY, Letters(Letters.count("\n".join([PROSE, *filter(None, PLAIN)])).reshape(Letters.SIZE, -1).astype(float)))


def _kind(text):
    shares = line_shares(own_words(text or ""), KNOWN)
    return next((k for k, s in zip(("list", "table", "junk"), shares[1:]) if s > 0.5), "prose")


@pytest.mark.parametrize("text", LISTS)
def test_lists(text):
    assert _kind(text) == "list"
    assert _kind("I have had the kiln for years.\n" + text * 2) == "list"


@pytest.mark.parametrize("text", TABLES)
def test_tables(text):
    assert _kind(text) == "table"


@pytest.mark.parametrize("text", JUNK)
def test_junk(text):
    assert _kind(text) == "junk"


@pytest.mark.parametrize("text", PLAIN)
def test_prose(text):
    assert _kind(text) == "prose"


@pytest.mark.parametrize(
    "text,own",
    [
        ("mine\n> theirs\n> more\nmine too", "mine\nmine too"), ("ann wrote:\n> a\nb", "b"), ("On 3 May, ann said:\n| a\n| b\nc", "c"),
        ("[quote=ann]a[/quote]\nb", "b"), ("[quote=ann][quote=bob]cut[/quote]\nb", "b"), ("[quote=a][quote=b]x[/quote]y[/quote]z", "z"),
        ("<blockquote><cite>a</cite>b</blockquote>\nc", "c"), ("a\n--\nSent from my phone", "a"), ("a\n-- \nb", "a"), ("a\n____________\nbees > people", "a"),
        (">)<|*?%+)*@<&|][%}^", ">)<|*?%+)*@<&|][%}^"), ("_______\n#######\n=======", "_______\n#######\n======="), (">> twice\n>once\nown", "own"), ("a\n-- ", "a"),
        ("[quote=a]1[/quote]b[quote=c]2[/quote]d", "bd"), ("| a | b |\n| c | d |", "| a | b |\n| c | d |"), ("[quote open and never closed", "[quote open and never closed"),
    ],
)
def test_own_words(text, own):
    assert own_words(text).strip() == own


def test_table_of_all_kinds(spark):
    variants = [PROSE.replace("kiln", w).replace("nine", n) for w in ("oven", "hub", "mast", "lid", "keel", "loom", "jig", "dial") for n in ("two", "five", "six", "ten", "forty", "some", "many", "three", "a few", "seven")]
    texts = [*variants, *LISTS, *TABLES, *JUNK, *PLAIN, "x" * 300_000, "the " + "word and " * 100_000]
    rows = [(i, t, "clash", 1.0) for i, t in enumerate(texts)] + [(0, texts[0], "clash", 1.0), (None, PROSE, "", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, distance double")
    words = spark.createDataFrame([(k, w) for k, v in COMMON.items() for w in v] + [(None, "x"), ("en", None)], "lang string, word string")
    out = text_quality(df, words).collect()
    assert len(out) == len(rows)
    # the distance takes the candidates: only they are checked, and none is left where nothing is far enough
    assert all(r["shares"] is None for r in out if r["distance"] <= FAR)
    assert sum(r["distance"] <= FAR for r in out) > 0.9 * len(variants)
    farther = {r["doc_id"]: r["kind"] for r in text_quality(df, words, far=sorted(r["distance"] for r in out)[-4]).collect()}
    assert 1 <= sum(k != "prose" for k in farther.values()) <= 3
    kinds = {r["doc_id"]: r["kind"] for r in out}
    n = len(variants)
    assert all(kinds[i] == "prose" for i in range(n))
    assert all(kinds[n + i] == "list" for i in range(len(LISTS)))
    assert all(kinds[n + len(LISTS) + i] == "table" for i in range(len(TABLES)))
    assert all(kinds[n + len(LISTS) + len(TABLES) + i] == "junk" for i in range(len(JUNK)))
    for r in out:
        assert set(r["contributions"]) == set(STATISTICS)
        assert np.isclose(sum(r["contributions"].values()), r["distance"], rtol=1e-6, atol=1e-6)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert text_quality(df, spark.createDataFrame([("en", "the")], "lang string, word string")).count() == 0
    one = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {r["kind"] for r in text_quality(one, spark.createDataFrame([], "lang string, word string")).collect()} == {"prose"}
