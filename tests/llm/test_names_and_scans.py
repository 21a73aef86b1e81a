import random

from marginalia.llm import names, scans


def clusters(spark, spellings):
    df = spark.createDataFrame([(s,) for s in spellings], "spelling string")
    found = {}
    for r in names.resolve(df).collect():
        found.setdefault(r.entity, set()).add(r.name)
    return sorted(map(sorted, found.values()))


def test_variants_of_persons(spark):
    same = ["Katherine Portumoba", "Portumoba, Kathy", "KATHERINE PORTUMOBA", "K. Portumoba", "Dr. Katherine Portumoba", "Katherine Portmuoba", "Kate Portumoba", "Prof K. L. Portumoba", "Katherin Portumoba", "KL Portumoba"]
    other = ["Deborah Portumoba", "Katherine Belkadin"]
    found = clusters(spark, [*same, *other, None, "", "—"])
    assert sorted({names.reduced(s) for s in same}) in found and [names.reduced(other[0])] in found and [names.reduced(other[1])] in found


def test_initials_of_two_persons_link_neither(spark):
    found = clusters(spark, ["Gregory Tallow", "Gabriela Tallow", "G. Tallow", "Tallow, G."])
    assert found == [["gabrielatallow"], ["gregorytallow"], ["gtallow", "tallowg"]]


def test_variants_of_organisations(spark):
    a = ["Larkukame Association for Data Standards", "Association of Data Standards, Larkukame", "Larkukame Data Stds Assn", "The Larkukame Association for Data Standards", "Larkukame DS Association", "Larkukame Asociation for Data Standards"]
    b = ["Larkukame Company for Public Records", "Larkukame Co. for Public Records"]
    c = ["Zenfe and Sons Centre GmbH", "Zenfe & Sons Ctr.", "Zenfe and Sons Centre GMBH."]
    assert clusters(spark, a + b + c) == sorted(sorted({names.reduced(x) for x in part}) for part in (a, b, c))


def test_aliases_from_data_and_pairs(spark):
    aliases = spark.createDataFrame([("given", "Fip", "Philomena"), ("word", "Obs.", "Observatory"), (None, None, None)], "alias_kind string, short_form string, full_form string")
    df = spark.createDataFrame([("Fip Marrow",), ("Philomena Marrow",), ("Tol Obs. of Stars",), ("Tol Observatory of Stars",)], "spelling string")
    found = names.variants(names.resolve(df, aliases))
    assert sorted(map(tuple, found.collect())) == [("fipmarrow", "philomenamarrow"), ("tolobservatoryofstars", "tolobsofstars")]
    assert names.variants(names.resolve(df.limit(0))).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randint(0, 80):02}", f"n{rng.randint(0, 80):02}") for _ in range(70)] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(30)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    found = {r.name: r.root for r in names.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert found == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_one_edit():
    assert all(names.one_edit("zachary", x) for x in ("zachary", "zcahary", "zachry", "zaachary", "zachory"))
    assert not any(names.one_edit("zachary", x) for x in ("zcaharry", "zach", "zahcray"))
    assert names.shortens("stds", "standards") and names.shortens("publ", "public") and not names.shortens("data", "standards") and not names.shortens("standard", "standards")


def page(number, body, head="ON THE OLD RIVER", foot="- {} -"):
    return [head, *body, foot.format(number)]


def test_furniture_is_found_by_recurrence():
    rng = random.Random(1)
    line = lambda: " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(9))
    lines = [x for n in range(3) for x in page(n + 7, [line() for _ in range(20)])]
    lines[5] = "1022"  # a number in a table
    found = scans.furniture(lines, 3)
    assert found == {0: "header", 21: "page_number", 22: "header", 43: "page_number", 44: "header", 65: "page_number"}
    sides = []
    for n in range(4):
        sides += [f"{n + 1}  The River" if n % 2 == 0 else f"The Rivcr  {n + 1}", *(line() for _ in range(15))]
    assert scans.furniture(sides, 4) == dict.fromkeys((0, 16, 32, 48), "header")
    assert scans.furniture([line() for _ in range(30)], 2) == {} and scans.furniture(["1"], 1) == {}


def test_page_numbers():
    good = {"7": 7, "[113]": 113, "Page 12": 12, "- 4 -": 4, "3 / 9": 3, "xiv": 14, "Page ll3": 113}
    for text, value in good.items():
        assert value in {v for _, v in scans.page_numbers(text)}, text
    assert not scans.page_numbers("The end of page") and not scans.page_numbers("15.7")


def test_confusions():
    assert scans.confusion_cost("tirnetable", "timetable") < 1 and scans.confusion_cost("5tudy", "study") < 1 and scans.confusion_cost("prelim!nary", "preliminary") < 1
    assert scans.confusion_cost("gorlufeal", "gorlupeal") == float("inf")
    assert scans.mixed("2O18") == "2018" and scans.mixed("seed1ing") == "seedling" and scans.mixed("simuIation") == "simulation" and scans.mixed("study") is None and scans.mixed("2018") is None


def scan_frame(spark):
    words = "the quiet river bends around an ancient meadow before reaching some distant harbour where sailors mended their nets during long winter evenings".split()
    clean = [" ".join(random.Random(i).choices(words, k=300)) + " a two-stage plan and the two-stage test." for i in range(12)]
    rng = random.Random(9)
    body = [" ".join(rng.choices(words, k=8)) for _ in range(30)]
    body[3] = "the quiet rivcr bends around an anc-"
    body[4] = "ient meadow before reaching 5ome distant"
    body[6] = "harbour where the sailors met for a two-"
    body[7] = "stage plan during long winter evenings"
    scanned = [x for n in range(2) for x in page(n + 1, body[15 * n : 15 * n + 15], head="River Notes")]
    rows = [(f"c{i}", t, "txt", None) for i, t in enumerate(clean)] + [("scan", "\n".join(scanned), "PDF", 2), ("scan", "\n".join(scanned), "PDF", 2), ("none", None, "pdf", 2), ("empty", "", "pdf", 2), (None, "\n".join(scanned), "pdf", 2)]
    return spark.createDataFrame(rows, "id string, text string, type string, pages int")


def test_findings_and_repair(spark):
    df = scan_frame(spark)
    found = sorted({(r.id, r.line_no, r.kind) for r in scans.findings(df, "id", "text", "type", "pages").collect()})
    assert found == [("scan", 0, "header"), ("scan", 4, "hyphen"), ("scan", 4, "misread"), ("scan", 5, "misread"), ("scan", 16, "page_number"), ("scan", 17, "header"), ("scan", 33, "page_number")]
    text = " ".join(r.paragraph for r in scans.repair(df, "id", "text", "type", "pages").orderBy("paragraph_no").collect())
    assert "quiet river bends around an ancient meadow before reaching some distant" in text and "River Notes" not in text and "two-stage plan" in text and "two- stage" not in text
    assert scans.findings(df.limit(0), "id", "text", "type", "pages").count() == 0


def test_scanned_texts_are_known_by_their_lines():
    line = "the quiet river bends around an ancient"
    printed = [line] * 12
    assert scans.is_scanned("PDF", 1, "\n".join(printed)) and scans.is_scanned("pdf", 1, "\n".join(printed[:3]))
    assert scans.is_scanned("pdf", 1, "\n".join([*printed, "x" * 120, *printed]))  # one wide line
    assert not scans.is_scanned("pdf", 1, "\n".join(["One sentence stands here.", "Another one is below."] * 6))
    assert not scans.is_scanned("pdf", 1, line * 30) and not scans.is_scanned("pdf", None, "\n".join(printed)) and not scans.is_scanned("txt", 1, "\n".join(printed)) and not scans.is_scanned("pdf", 1, "")


def test_words_of_lines():
    lines = ["It was a well-", "known riv¬", "er in the", "north", "Head", "of it"]
    body = scans.words_of(lines, {4})
    assert [x.words for x in body] == [["It", "was", "a", "wellknown"], ["river"], ["in", "the"], ["north"], ["of", "it"]]
    assert [x.broken and (x.broken.left, x.broken.next_line) for x in body] == [("well", 1), ("riv", 2), None, None, None] and [x.rest for x in body] == [False, True, True, False, False]
    assert scans.words_of(["a-", "", "-"], set())[0].broken is None and scans.words_of([], set()) == []


def test_frequent_misreadings_and_wide_lines_are_found(spark):
    """Neither a misreading in 50 documents nor a line of 120 characters is passed over."""
    words = "the quiet river bends around an ancient meadow before reaching some distant harbour where sailors mended their nets during long winter evenings low may and term".split()
    clean = [(f"c{i}", " ".join(random.Random(i).choices(words, k=200)), "txt", None) for i in range(400)]
    rows = []
    for i in range(50):
        rng = random.Random(1000 + i)
        body = [" ".join(rng.choices(words, k=8)) for _ in range(20)]
        body[4], body[9], body[12] = "their quiet river bends qu1et and lovv", "sailors mended 2O18 nets during rnay", " ".join(rng.choices(words, k=25))[:120]
        rows.append((f"s{i}", "\n".join(body), "pdf", 1))
    df = spark.createDataFrame([*clean, *rows], "id string, text string, type string, pages int")
    found = {(r.word, r.repair) for r in scans.findings(df, "id", "text", "type", "pages").where("kind = 'misread'").collect()}
    assert found == {("qu1et", "quiet"), ("lovv", "low"), ("rnay", "may"), ("2O18", "2018")}
    assert scans.undone("tvvo") == {"two"} and "may" in scans.undone("rnay") and "and" in scans.undone("ancl")


def test_scans_send_no_table_through_the_driver(spark, monkeypatch):
    plans = []
    real = scans.stage

    def staged(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(scans, "stage", staged)
    found = scans.repair(scan_frame(spark), "id", "text", "type", "pages")
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("SortMergeJoin") for p in plans) >= 10 and not [p for p in plans if "Broadcast" in p]


def test_long_words_are_corrected_by_their_segments(spark):
    """A word of 1,500 characters leaves a million of them after two deletions."""
    rng = random.Random(4)
    long = ["".join(rng.choices("abdgkmprtuvwxyz", k=n)) for n in (31, 32, 33, 34, 35, 60, 1500)]
    reads = [w[:k] + x + w[k + 1 :] for w in long for k, x in ((5, "!"), (len(w) - 4, "!"))]
    meant = [w[:k] + "i" + w[k + 1 :] for w in long for k in (5, len(w) - 4)]
    wider = [w[:7] + x + w[7:] for w in long for x in ("rn", "m")]
    known = spark.createDataFrame([(w, 9) for w in [*meant, *wider[1::2]]], "word string, n bigint")
    asked = spark.createDataFrame([(w, 1) for w in [*reads, *wider[::2]]], "word string, n bigint")
    found = {(r["read"], r.meant) for r in scans._corrections(asked, known).collect()}
    assert found >= {*zip(reads, meant), *zip(wider[::2], wider[1::2])}
    assert all(len(scans.entries(w, known)) <= 125 for w in long[-2:] for known in (True, False))
    for a, b in (("rivcr", "river"), ("abcdef", "abcdef"), ("abcdef", "cdef"), ("abcdef", "bcdefxy"), ("abcdef", "def"), ("abcdef", "axcyez")):
        assert scans._alike(a, b) == bool(scans.deletes(a) & scans.deletes(b)), (a, b)
    w = long[-1]
    assert scans.confusion_cost(w[:700] + "1" + w[700:], w[:700] + "l" + w[700:]) == 0.5 and scans.confusion_cost(w + "q", w) == float("inf")
