"""Linking the spellings of names of persons and organisations.

Every name is rewritten in all the ways that rules of typing allow to come from one original: nicknames to
full names, titles and articles off, tokens in any order, given names to initials, legal forms and
abbreviations to one form, words to their acronym, and single letters left out (where a typing error may be). Equal
rewritings meet in an equi-join. A link is scored by how rare its rewriting is: one that leads to
several different originals (initials of two persons of one surname) says nothing and links none of them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.runtime import stage

# Short forms of given names in English that are no mere beginnings of the full name.
NICKNAMES = """
abby abigail; alex alexander; sandy alexander; andy andrew; tony anthony; ben benjamin; charlie charles; chuck charles; chris christopher; kit christopher; topher christopher;
dan daniel; danny daniel; debbie deborah; deb deborah; dot dorothy; dottie dorothy; dolly dorothy; ted edward; ned edward; ed edward; eddie edward; liz elizabeth; beth elizabeth; betty elizabeth;
eliza elizabeth; libby elizabeth; lizzie elizabeth; fred frederick; freddie frederick; greg gregory; jackie jacqueline; jim james; jimmy james; jamie james; jenny jennifer; jen jennifer;
jo josephine; josie josephine; joe joseph; joey joseph; kate katherine; kathy katherine; katie katherine; kit katherine; lucy lucia; peggy margaret; maggie margaret; meg margaret; greta margaret; matt matthew;
mike michael; mick michael; mickey michael; nick nicholas; pat patricia; trish patricia; patty patricia; tricia patricia; pippa philippa; becky rebecca; becca rebecca; rick richard; dick richard; rich richard;
ricky richard; rob robert; bob robert; bobby robert; robbie robert; sam samuel; sammy samuel; steve stephen; sue susan; susie susan; suzie susan; theo theodore; teddy theodore; ted theodore;
tom thomas; tommy thomas; tim timothy; timmy timothy; vicky victoria; tori victoria; bill william; will william; billy william; willy william; liam william; zach zachary; zack zachary; zac zachary
"""
# Abbreviations of words in names of organisations.
ABBREVIATIONS = """
inst institute; lab laboratory; labs laboratory; laboratories laboratory; fdn foundation; found foundation; assoc association; assn association; corp corporation; co company; center centre; ctr centre;
cntr centre; soc society; u university; appl applied; mater materials; mat materials; stud studies; wtr water; univ university; dept department; dep department; dpt department; agcy agency; agy agency; cncl council;
hlth health; publ public; pub public; rec records; recs records; std standards; stds standards; stand standards; transp transport; trans transport; plan planning; plng planning; planng planning;
sci science; sys systems; syst systems; en energy; engy energy; enrgy energy; mar marine; acoust acoustics; acous acoustics; res research; rsch research; test testing; tstg testing; rur rural; agric agriculture;
bros brothers; intl international; natl national; govt government; mgmt management; tech technology
"""
TITLES = {"dr", "prof", "professor", "mr", "mrs", "miss", "herr", "frau", "mme", "phd", "jr", "sr", "dipl", "ing"}
#: Titles that are other words too, unless they come first.
FIRST_TITLES = {"ms", "sir", "dame"}
SMALL_WORDS = {"the", "for", "of", "and", "de", "des", "der", "für", "fur", "et", "y", "und"}
LEGAL = {"gmbh": "gmbh", "ltd": "ltd", "limited": "ltd", "inc": "inc", "incorporated": "inc", "sa": "sa", "llc": "llc", "plc": "plc", "ag": "ag"}
#: What is left of a link's weight for each kind of rewriting; a weight is divided by the originals that compete.
WEIGHTS = {"same": 1.0, "legal": 0.9, "letters": 0.9, "word": 0.8, "initials": 0.7, "acronym": 0.7}
LEAST_SCORE = 0.5
#: Rows of an alias table that may be sent to all executors.
MOST_ALIASES = 100_000

_WORD = re.compile(r"[^\W_]+")


def _table(text: str) -> dict[str, set[str]]:
    found: dict[str, set[str]] = {}
    for entry in text.replace("\n", " ").split(";"):
        short, full = entry.split()
        found.setdefault(short, set()).add(full)
    return found


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def reduced(name: str) -> str:
    """Letters and digits of the lower-cased name."""
    return "".join(c for c in name.lower() if c.isalnum())


def one_edit(a: str, b: str) -> bool:
    """Whether one letter put in, left out, changed, or swapped with its neighbour makes ``a`` into ``b``."""
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return longer[i + 1 :] == shorter[i:]


def shortens(short: str, word: str) -> bool:
    """Whether ``short`` abbreviates ``word``: its letters in order, from the first on, and clearly fewer."""
    if not 2 <= len(short) <= len(word) - 2 or short[0] != word[0]:
        return False
    rest = iter(word)
    return all(c in rest for c in short)


def _without_one(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) >= 4 else {word}


class Rules:
    """The tables that rewritings use; more aliases may come from data."""

    def __init__(self, aliases: list[tuple[str, str, str]] = ()):  # type: ignore[assignment]
        self.given, self.word = _table(NICKNAMES), _table(ABBREVIATIONS)
        for kind, short, full in aliases:
            if short and full:
                table = self.given if kind == "given" else self.word
                table.setdefault(fold(short).strip(". "), set()).add(fold(full).strip(". "))
        self.full_words = {w for ws in self.word.values() for w in ws}

    def rewritings(self, name: str) -> list[tuple[str, str, str, str]]:
        """All (kind, form, detail, level) of a name; equal kind and form of two names may link them.

        ``detail`` is what the form leaves open and a link must confirm; ``level`` tells full names from those with initials.
        """
        spaced = name.replace("&", " and ")
        raw = _WORD.findall(re.sub(r"(?i)\bs\.\s?a\.?(?=\W|$)", " sa ", spaced))
        words = [fold(w) for w in raw]
        upper = sum(w.isupper() for w in raw) == len(raw)
        first = 1 if words and words[0] in FIRST_TITLES else 0
        kept = [(w, r) for w, r in zip(words[first:], raw[first:]) if w not in TITLES and w not in SMALL_WORDS]
        long = [(w, r) for w, r in kept if len(w) > 2 or len(w) == 2 and w in self.given and not (r.isupper() and not upper)]
        initials = "".join(w for w, r in kept if (w, r) not in long)
        tokens = [w for w, _ in long]
        legal = [LEGAL[w] for w, _ in kept if w in LEGAL]
        typed = any(w in self.full_words or w in self.word for w in tokens)
        if legal and len(kept) > 2 or len(tokens) > 2 or typed and len(tokens) + len(initials) > 2:
            return self._organisation([w for w, _ in kept if w not in LEGAL], legal)
        return self._person(tokens, initials)

    def _person(self, tokens: list[str], initials: str) -> list[tuple[str, str, str, str]]:
        found: list[tuple[str, str, str, str]] = []
        if len(tokens) == 2:
            # A short form may be a full name of its own, or a typing error of another.
            for pair in product(*({t, *self.given.get(t, ())} for t in tokens)):
                a, b = sorted(pair)
                found.append(("same", f"{a} {b}", "", "full"))
                for fixed, open_ in ((a, b), (b, a)):
                    found += [("letters", f"{fixed} {d}", open_, "full") for d in _without_one(open_)]
                    found.append(("initials", f"{fixed} {open_[0]}", "", "full"))
                    if initials:
                        found.append(("both_initials", f"{fixed} {open_[0]}{initials[0]}", "", "full"))
                    found += [("near_initials", f"{d} {open_[0]}", fixed, "full") for d in _without_one(fixed)]
        elif len(tokens) == 1 and initials:
            s, i = tokens[0], initials[0]
            found.append(("initials", f"{s} {i}", "", "initials"))
            if len(initials) > 1:
                found.append(("both_initials", f"{s} {initials[:2]}", "", "initials"))
            found += [("near_initials", f"{d} {i}", s, "initials") for d in _without_one(s)]
        elif tokens:
            found.append(("same", " ".join(sorted(tokens)), "", "full"))
            found += [("letters", d, tokens[0], "full") for d in _without_one(tokens[0])] if len(tokens[0]) > 5 else []
        return found

    def _organisation(self, words: list[str], legal: list[str]) -> list[tuple[str, str, str, str]]:
        found: list[tuple[str, str, str, str]] = []
        options = [self.word.get(w, {w}) for w in words]
        form = " ".join(sorted(set(legal)))
        for choice in product(*options):  # words with several originals are few; all others have one choice
            versions = [list(choice)]
            for n in range(2, len(choice)):  # neighbouring words by their first letters
                versions += [[*choice[:i], "".join(w[0] for w in choice[i : i + n]), *choice[i + n :]] for i in range(len(choice) - n + 1)]
            for k, version in enumerate(versions):
                v = sorted(version)
                found.append(("acronym" if k else "same", f"{' '.join(v)} | {form}", "", "full"))
                if k == 0:
                    found.append(("legal", " ".join(v), form, "full"))
                if k == 0:
                    for i, w in enumerate(v):
                        rest = " ".join(v[:i] + v[i + 1 :])
                        found += [("letters", f"{rest} | {form} | {d}", w, "full") for d in _without_one(w)]
                        if len(v) > 2:
                            found.append(("word", f"{rest} | {form} | {w[0]}", w, "full"))
        return found


_FORMS = "name string, kind string, form string, detail string, level string"


def rewritings(names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(name, kind, form, detail, level) of distinct spellings; ``name`` is the reduced one.

    ``names`` has a column ``spelling``; null spellings and those without letters or digits have no rows.
    ``aliases`` (alias_kind, short_form, full_form) is a small table that is sent to all executors; its size is checked.
    """
    rows = [tuple(r) for r in aliases.select("alias_kind", "short_form", "full_form").limit(MOST_ALIASES + 1).collect()] if aliases is not None else []
    if len(rows) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(rows)
        for batch in batches:
            found = [(key, *f) for s in batch.column(0).to_pylist() if (key := reduced(s)) for f in set(rules.rewritings(s))]
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], names=["name", "kind", "form", "detail", "level"])

    return names.select("spelling").where("spelling IS NOT NULL").distinct().mapInArrow(run, _FORMS).distinct()


def components(links: DataFrame) -> DataFrame:
    """(name, root) of all ends of ``links`` (a, b): root is the least name that can be reached."""
    edges = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stage(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("name"), F.least("a", "m").alias("root")), "labels")
    while True:
        # The least root of a name's neighbours, and then the root's own root.
        seen = edges.join(labels.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        hop = labels.join(seen.withColumnRenamed("a", "name"), "name").select("name", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = hop.join(labels.toDF("root", "up"), "root", "left").select("name", "old", F.coalesce(F.least("root", "up"), "root").alias("root"))
        after = stage(jump, "labels")
        labels = after.select("name", "root")
        if after.where("root <> old").isEmpty():
            return labels


def _verified(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, kind, x, y) whose open parts x and y confirm the link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, x, y = (batch.column(i).to_pylist() for i in (2, 3, 4))
            ok = [one_edit(p, q) if k != "word" else shortens(p, q) or shortens(q, p) for k, p, q in zip(kind, x, y)]
            yield batch.filter(pa.array(ok, pa.bool_())).select([0, 1, 2])

    return pairs.mapInArrow(run, "a string, b string, kind string")


def links(forms: DataFrame) -> DataFrame:
    """(a, b, kind, score) between reduced names that mean the same, linear in the names of a form where forms are equal."""
    full = forms.where("level = 'full'")
    same = full.where("kind = 'same'").groupBy("form").agg(F.min("name").alias("a")).join(full.where("kind = 'same'").select("form", F.col("name").alias("b")), "form")
    same = same.where("a <> b").select("a", "b", F.lit("same").alias("kind"), F.lit(1.0).alias("score"))
    # Without legal form: only where all names of the form have the same one or none.
    legal = full.where("kind = 'legal'")
    ways = legal.groupBy("form").agg(F.min("name").alias("a"), F.countDistinct(F.nullif("detail", F.lit(""))).alias("ways"))
    bare = ways.join(legal.select("form", F.col("name").alias("b")), "form").where("a <> b")
    bare = bare.select("a", "b", F.lit("legal").alias("kind"), (WEIGHTS["legal"] / F.greatest("ways", F.lit(1))).alias("score"))
    # One letter or an abbreviated word: names with the same form and open part are linked already; one stands for all.
    open_ = full.where("kind IN ('letters', 'word')").groupBy("kind", "form", "detail").agg(F.min("name").alias("name"))
    x = open_.select("kind", "form", F.col("detail").alias("x"), F.col("name").alias("a"))
    y = open_.select("kind", "form", F.col("detail").alias("y"), F.col("name").alias("b"))
    near = _verified(x.join(y, ["kind", "form"]).where("x < y AND a <> b").select("a", "b", "kind", "x", "y").distinct())
    near = near.select("a", "b", "kind", F.when(F.col("kind") == "word", WEIGHTS["word"]).otherwise(WEIGHTS["letters"]).alias("score"))
    return same.unionByName(bare).unionByName(near).where(F.col("score") > LEAST_SCORE).distinct()


def _initials(forms: DataFrame, roots: DataFrame) -> DataFrame:
    """Links of names with initials or an acronym to the one original that they fit; initials that fit none, to each other."""
    short = forms.where("level = 'initials'")
    people = forms.where("level = 'full' AND kind IN ('both_initials', 'initials', 'near_initials', 'acronym')").join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    acronyms = forms.where("kind = 'same'").select("form", F.col("name").alias("b")).join(people.where("kind = 'acronym'").select("form", "root").distinct(), "form").select("b", "root", F.lit(0).alias("far"))
    exact = short.where("kind = 'initials'").select("form", F.col("name").alias("b")).join(people.where("kind = 'initials'").select("form", "root").distinct(), "form").select("b", "root", F.lit(0).alias("far"))
    # Two initials that fit say more than the first alone.
    both = short.where("kind = 'both_initials'").select("form", F.col("name").alias("b")).join(people.where("kind = 'both_initials'").select("form", "root").distinct(), "form").select("b", "root", F.lit(-1).alias("far"))
    pairs = short.where("kind = 'near_initials'").select("form", F.col("name").alias("b"), F.col("detail").alias("y")).join(people.where("kind = 'near_initials'").select("form", F.col("root").alias("a"), F.col("detail").alias("x")).distinct(), "form")
    near = _verified(pairs.select("a", "b", F.lit("letters").alias("kind"), "x", "y").distinct()).select("b", F.col("a").alias("root"), F.lit(1).alias("far"))
    fits = both.unionByName(exact).unionByName(near).unionByName(acronyms).groupBy("b", "root").agg(F.min("far").alias("far"))
    # Surnames spelled alike come before those that differ in a letter.
    closest = fits.groupBy("b").agg(F.min("far").alias("least"))
    fits = fits.join(closest, "b").where("far = least").groupBy("b").agg(F.min("root").alias("a"), (F.lit(WEIGHTS["initials"]) / F.count("*")).alias("score"))
    fitted = fits.where(F.col("score") > LEAST_SCORE).select("a", "b")
    alone = short.where("kind = 'initials'").select("form", F.col("name").alias("b"))
    together = alone.join(alone.groupBy("form").agg(F.min("b").alias("a")), "form").where("a <> b").select("a", "b")
    return fitted.unionByName(together)


def resolve(names: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(name, entity): every reduced name with the least reduced name of its entity.

    ``names`` has a column ``spelling``. Null spellings and those without letters or digits are left out; names
    that are linked to no other are their own entity.
    """
    forms = stage(rewritings(names, aliases), "forms")
    strong = stage(links(forms), "links")
    roots = components(strong)
    more = _initials(forms, roots)
    final = components(strong.select("a", "b").unionByName(more))
    return forms.select("name").distinct().join(final, "name", "left").select("name", F.coalesce("root", "name").alias("entity"))


def variants(entities: DataFrame) -> DataFrame:
    """Pairs (name_a, name_b), name_a < name_b, of the spellings of each entity."""
    a = entities.select("entity", F.col("name").alias("name_a"))
    return a.join(entities.select("entity", F.col("name").alias("name_b")), "entity").where("name_a < name_b").select("name_a", "name_b")
