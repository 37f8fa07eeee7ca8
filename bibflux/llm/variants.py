"""Variant spellings of persons and venues.

Spellings are reduced to token sets first: a person's folded surname and given initial, a venue's significant words. Close sets are found
by a prefix-filtered set-similarity join on the q-grams of their tokens: sets within one edit share all but a few q-grams, so they share one
of the first few in any common order; rare q-grams come first in that order, so the lists that meet stay short. Tokens too short for q-grams are met by
shared deletions. What meets is verified by a soft similarity of all tokens, surname and given name, in which rare tokens count more and an edit between
two surnames that are both well attested counts for more than one. Two keys that are each one edit from a more frequent third are linked through it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibflux.functions.fold import fold_accents
from bibflux.functions.let import let
from bibflux.operators.components import connected_components
from bibflux.operators.packed import PARTICLES
from bibflux.session import written

#: Short forms of given names, each with the names it may stand for.
NICKNAMES: dict[str, list[str]] = {
    "bob": ["robert"],
    "rob": ["robert"],
    "bobby": ["robert"],
    "bert": ["robert", "albert"],
    "bill": ["william"],
    "will": ["william"],
    "billy": ["william"],
    "willy": ["william"],
    "liam": ["william"],
    "ted": ["edward", "theodore"],
    "ned": ["edward"],
    "eddie": ["edward"],
    "ed": ["edward", "edgar"],
    "liz": ["elizabeth"],
    "beth": ["elizabeth"],
    "betty": ["elizabeth"],
    "lisa": ["elizabeth"],
    "eliza": ["elizabeth"],
    "kate": ["katherine", "catherine"],
    "kathy": ["katherine", "catherine"],
    "katie": ["katherine"],
    "kat": ["katherine"],
    "mike": ["michael"],
    "mick": ["michael"],
    "nick": ["nicholas"],
    "nico": ["nicholas"],
    "ben": ["benjamin"],
    "sam": ["samantha", "samuel"],
    "gabi": ["gabriela"],
    "gaby": ["gabriela"],
    "bella": ["isabella"],
    "izzy": ["isabella"],
    "fritz": ["friedrich"],
    "fred": ["friedrich", "frederick"],
    "lupe": ["guadalupe"],
    "lupita": ["guadalupe"],
    "sasha": ["alexander", "alexandra"],
    "alex": ["alexander", "alexandra"],
    "sandy": ["alexander"],
    "pepa": ["josefina"],
    "fina": ["josefina"],
    "pepe": ["jose"],
    "hannes": ["johannes"],
    "hans": ["johannes"],
    "jan": ["johannes"],
    "peggy": ["margaret"],
    "maggie": ["margaret"],
    "meg": ["margaret"],
    "rita": ["margarita"],
    "paco": ["francisco"],
    "pancho": ["francisco"],
    "frank": ["francis", "francisco"],
    "kiko": ["francisco"],
    "dora": ["theodora"],
    "thea": ["theodora"],
    "teddy": ["theodora", "theodore"],
    "vova": ["vladimir"],
    "volodya": ["vladimir"],
    "vlad": ["vladimir"],
    "dick": ["richard"],
    "rick": ["richard"],
    "jim": ["james"],
    "jimmy": ["james"],
    "jack": ["john"],
    "johnny": ["john"],
    "tom": ["thomas", "tomas"],
    "tommy": ["thomas"],
    "tony": ["anthony", "antonio"],
    "toni": ["antonio"],
    "dan": ["daniel"],
    "danny": ["daniel"],
    "dave": ["david"],
    "joe": ["joseph"],
    "steve": ["steven", "stephen"],
    "chris": ["christopher", "christina"],
    "matt": ["matthew"],
    "andy": ["andrew"],
    "greg": ["gregory"],
    "jeff": ["jeffrey"],
    "ken": ["kenneth"],
    "larry": ["lawrence"],
    "ron": ["ronald"],
    "sue": ["susan"],
    "jenny": ["jennifer"],
    "jen": ["jennifer"],
    "becky": ["rebecca"],
    "debbie": ["deborah"],
    "patty": ["patricia"],
    "pat": ["patrick", "patricia"],
    "lola": ["dolores"],
    "concha": ["concepcion"],
    "chema": ["jose"],
    "nacho": ["ignacio"],
    "memo": ["guillermo"],
    "beto": ["alberto", "roberto"],
    "lalo": ["eduardo"],
    "kolya": ["nikolai"],
    "misha": ["mikhail"],
    "dima": ["dmitri"],
    "tanya": ["tatiana"],
    "katya": ["ekaterina"],
    "natasha": ["natalia"],
    "heinz": ["heinrich"],
    "sepp": ["josef"],
}
_STOP = ("of", "on", "in", "and", "for", "the", "a", "an", "at", "to", "de", "del", "la", "las", "los", "el", "y", "e", "en", "du", "des", "et", "der", "die", "das", "und", "fur")


def _map(pairs: dict[str, list[str]]) -> Column:
    return F.create_map(*(c for k, v in pairs.items() for c in (F.lit(k), F.array(*map(F.lit, v)))))


def parse_persons(spellings: DataFrame) -> DataFrame:
    """``(name)`` with its ``surname`` (folded, without particles), ``given`` forms, ``short`` (initial or dotted start) and ``middle`` initial.

    A name without comma is given name first, unless its last part is an initial or is used as a given name more often than its first
    part among the names with comma. Names without two parts are left out: they name no one in particular.
    """
    folded = F.regexp_replace(F.regexp_replace(F.lower(fold_accents(F.col("name"))), r"['’`´\-‐]", ""), r"(?<=\p{L})\.(?=\p{L})", ". ")
    words = lambda c: F.filter(F.split(F.regexp_replace(c, r"[^\p{L}.]+", " "), " "), lambda w: (F.regexp_replace(w, r"\.", "") != "") & ~w.isin(*PARTICLES))
    comma = F.instr(folded, ",") > 0
    rows = spellings.select("name", comma.alias("_comma"), words(F.substring_index(folded, ",", 1)).alias("_a"), F.when(comma, words(F.substring_index(folded, ",", -1))).alias("_b"))
    rows = rows.withColumn("_n", F.size("_a"))
    bare = lambda w: F.regexp_replace(w, r"\.", "")
    first, last = F.get("_a", F.lit(0)), F.get("_a", F.col("_n") - 1)
    full = lambda w: (F.length(bare(w)) > 1) & ~F.endswith(w, F.lit("."))
    uses = rows.filter(F.col("_comma") & full(F.get("_b", F.lit(0)))).groupBy(F.get("_b", F.lit(0)).alias("_w")).agg(F.count(F.lit(1)).alias("_uses"))
    plain = rows.filter(~F.col("_comma") & (F.col("_n") >= 2)).withColumns({"_first": first, "_last": last})
    plain = plain.join(uses.withColumnsRenamed({"_w": "_first", "_uses": "_uf"}), "_first", "left").join(uses.withColumnsRenamed({"_w": "_last", "_uses": "_ul"}), "_last", "left")
    used = lambda c: F.coalesce(F.col(c), F.lit(0))
    turned = (F.length(bare(F.col("_last"))) == 1) | (F.endswith(F.col("_last"), F.lit(".")) & (F.length(F.col("_last")) <= 4)) | ((F.col("_n") == 2) & full(F.col("_first")) & full(F.col("_last")) & (used("_ul") > used("_uf")))
    plain = plain.select(
        "name",
        F.when(turned, F.filter("_a", lambda w, i: (i < 1) | full(w) & (i < F.col("_n") - 1))).otherwise(F.slice("_a", F.col("_n"), 1)).alias("_s"),
        F.when(turned, F.slice("_a", F.col("_n"), 1)).otherwise(F.slice("_a", 1, F.col("_n") - 1)).alias("_g"),
    )
    inverted = rows.filter("_comma").select("name", F.col("_a").alias("_s"), F.col("_b").alias("_g"))
    both = plain.unionByName(inverted).filter((F.size("_s") > 0) & (F.size("_g") > 0))
    g = F.get("_g", F.lit(0))
    forms = F.coalesce(F.element_at(_map(NICKNAMES), bare(g)), F.array(bare(g)))
    return both.select(
        "name",
        F.regexp_replace(bare(F.array_join("_s", "")), "ph", "f").alias("surname"),
        F.when(full(g), F.array_union(forms, F.array(bare(g)))).alias("given"),
        F.when(~full(g), bare(g)).alias("short"),
        F.substring(F.get("_g", F.lit(1)), 1, 1).alias("middle"),
        F.array_distinct(F.transform(forms, lambda f: F.substring(f, 1, 1))).alias("initials"),
    )


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two strings differ by at most one insertion, deletion, replacement or swap of two letters."""
    letters = lambda c: F.sort_array(F.split(c, ""))
    d = F.levenshtein(a, b, 2)
    return ((d >= 0) & (d <= 1)) | ((d == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b)))


def _grams(c: Column, q: int) -> Column:
    """``array<struct<gram,pos>>`` of the q-grams of a string with marked ends."""
    # letters by place, since a substring is counted off from the beginning each time
    letters = F.filter(F.split(F.concat(F.lit("^"), c, F.lit("$")), ""), lambda x: x != "")
    gram = lambda l, i: F.concat_ws("", *(F.get(l, i + k - 1) for k in range(q)))
    return let(letters, lambda l: F.transform(F.sequence(F.lit(1), F.greatest(F.size(l) - q + 1, F.lit(1))), lambda i: F.struct(gram(l, i).alias("gram"), i.alias("pos"))))


def _deletions(c: Column) -> Column:
    """A string and what is left of it without each of its letters."""
    return let(c, lambda x: F.array_distinct(F.concat(F.array(x), F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))))))


def close_keys(keys: DataFrame, text: str, block: str, prefix: int = 5, q: int = 3) -> DataFrame:
    """Pairs of ``keys(id, text, block, ...)`` of equal block within one edit, id_a < id_b; every column but the block comes back with ``_a`` and ``_b``.

    One edit changes at most four of the 3-grams of a string (a swap), so two strings of five letters or more within one edit share one of
    the first five in a common order. The order is by rarity within the block, then by the gram itself. Two strings of up to five letters,
    whose q-grams one edit can all change, share a string after one deletion each.
    """
    carried = [c for c in keys.columns if c != block]
    # only numbers and grams move while a key is in pieces; the keys themselves, which may be long, come back once few pieces are left
    rows = keys.filter(F.length(text) >= 5).select("id", block, F.length(text).alias("_n"), F.explode(_grams(F.col(text), q)).alias("_g"))
    rows = rows.select("id", block, "_n", "_g.gram", "_g.pos")
    rarity = rows.groupBy(block, "gram").agg(F.count(F.lit(1)).alias("_df")).filter("_df > 1")
    # a gram that only one key has meets nothing, but keeps its place at the head of the order
    kept = rows.join(rarity, [block, "gram"]).groupBy("id", block, "_n").agg(F.sort_array(F.collect_list(F.struct("_df", "gram", "pos"))).alias("_l"))
    room = F.lit(prefix) - (F.col("_n") - F.size("_l"))
    kept = kept.filter(room > 0).select("id", block, F.explode(F.slice("_l", F.lit(1), room)).alias("_g")).select("id", block, "_g.gram", "_g.pos")
    short = keys.filter(F.length(text) <= 5).select("id", block, F.explode(_deletions(F.col(text))).alias("gram")).select("id", block, F.concat(F.lit("-"), "gram").alias("gram"), F.lit(0).alias("pos"))
    kept = kept.unionByName(short).join(keys.select("id", F.struct(*carried).alias("_k")), "id").drop("id")
    a, b = (kept.select(F.col("_k").alias(f"_{s}"), block, "gram", F.col("pos").alias(f"_p{s}")) for s in "ab")
    ta, tb = F.col(f"_a.{text}"), F.col(f"_b.{text}")
    met = a.join(b, [block, "gram"]).filter((F.col("_a.id") < F.col("_b.id")) & (F.abs(F.col("_pa") - F.col("_pb")) <= 1) & (F.abs(F.length(ta) - F.length(tb)) <= 1))
    return met.filter(_one_edit(ta, tb)).select(*(F.col(f"_{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in carried)).distinct()


def person_variants(spellings: DataFrame, least: float = 0.7) -> DataFrame:
    """Pairs ``(name_a, name_b)`` of different spellings of ``spellings(name)`` that mean the same person, name_a < name_b.

    Repeated spellings count once; nulls, empty names and names of one part have no variants, for a single part names no one in particular. Same person: surnames equal up
    to case, accents and particles, or close; given names equal, close, one a short form or a beginning of the other; middle initials that do not
    contradict each other; and a soft similarity of surname and given name, weighted by rarity, of at least ``least``.
    """
    parsed = parse_persons(written(spellings.filter("name is not null").select("name").distinct()))
    names = written(parsed.withColumn("initial", F.explode("initials")).drop("initials").withColumn("key", F.xxhash64("surname", "initial")))
    keys = names.groupBy(F.col("key").alias("id"), "surname", "initial").agg(F.count(F.lit(1)).alias("uses"))
    keys = written(keys.join(keys.groupBy("surname").agg(F.count(F.lit(1)).alias("ds")), "surname"))
    total, n_names = keys.count(), names.count()
    edges = written(close_keys(keys, "surname", "initial"))
    # through a key that is used at least as often as both
    cols = ("id", "uses", "ds", "surname")
    turned = edges.select(*(F.col(f"{c}_{s}").alias(f"{c}_{t}") for s, t in ("ba", "ab") for c in cols))
    either = edges.select(*turned.columns).union(turned)
    spokes = either.filter("uses_b >= uses_a")
    size = lambda x, y: F.greatest(F.length(x), F.length(y))
    ends = lambda p, s: p.select(F.col("id_b").alias("_hub"), F.col("id_a").alias(f"id_{s}"), F.col("ds_a").alias(f"ds_{s}"), F.col("surname_a").alias(f"surname_{s}"))
    two = ends(spokes, "a").join(ends(spokes, "b"), "_hub").filter("id_a < id_b")
    link = lambda p, edits: p.select("id_a", "id_b", F.least("ds_a", "ds_b").alias("ds"), (F.lit(float(edits)) / size("surname_a", "surname_b")).alias("loss"))
    equal = keys.select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), "ds", F.lit(0.0).alias("loss"))
    links = link(edges, 1).union(link(two, 2)).groupBy("id_a", "id_b").agg(F.min("ds").alias("ds"), F.min("loss").alias("loss")).union(equal)
    # given names count by their rarity among all spellings
    first = F.coalesce(F.get("given", F.lit(0)), "short")
    given_df = names.groupBy(first.alias("_first")).agg(F.count(F.lit(1)).alias("_dg"))
    weighed = names.withColumn("_first", first).join(given_df, "_first").withColumn("wg", F.log1p(F.lit(n_names) / F.col("_dg")))
    cols = ("name", "given", "short", "middle", "wg")
    x, y = (weighed.select(F.col("key").alias(f"id_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in cols)) for s in "ab")
    pairs = links.join(x, "id_a").join(y, "id_b").filter((F.col("name_a") < F.col("name_b")) | (F.col("id_a") != F.col("id_b")) & (F.col("name_a") != F.col("name_b")))
    starts = lambda short, forms: F.exists(forms, lambda f: F.startswith(f, F.col(short)))
    close = F.exists("given_a", lambda f: F.exists("given_b", lambda g: (F.length(f) >= 5) & (F.length(g) >= 5) & _one_edit(f, g)))
    begun = (
        F.when(F.col("given_a").isNotNull(), starts("short_b", F.col("given_a")))
        .when(F.col("given_b").isNotNull(), starts("short_a", F.col("given_b")))
        .otherwise(F.startswith(F.col("short_a"), F.col("short_b")) | F.startswith(F.col("short_b"), F.col("short_a")))
    )
    both = F.col("given_a").isNotNull() & F.col("given_b").isNotNull()
    given = F.when(both, F.when(F.arrays_overlap("given_a", "given_b"), 1.0).when(close, 0.8).otherwise(0.0)).when(begun, 0.9).otherwise(0.0)
    middle = F.coalesce(F.col("middle_a") == F.col("middle_b"), F.lit(True)) | (F.col("middle_a") == "") | (F.col("middle_b") == "")
    surname = F.greatest(F.lit(0.0), 1 - F.col("loss") * (1 + F.log2("ds")))
    ws, wg = F.log1p(F.lit(total) / F.col("ds")), F.greatest("wg_a", "wg_b")
    fits = pairs.withColumn("_g", given).filter((F.col("_g") > 0) & middle).filter((ws * surname + wg * F.col("_g")) / (ws + wg) >= least)
    return fits.select(F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b")).distinct()


def parse_venues(spellings: DataFrame) -> DataFrame:
    """``(name)`` with its significant ``tokens`` in order and ``acronym`` if the spelling is nothing but one.

    Bracketed notes, subtitles after a colon, series notes and articles are dropped; "X, Annals of" is read as "Annals of X".
    """
    text = F.lower(fold_accents(F.regexp_replace(F.col("name"), "&", " and ")))
    text = F.regexp_replace(text, r"\s*[(\[][^()\[\]]*[)\]]\s*", " ")
    text = F.regexp_replace(text, r"\s+:.*$|,?\s+new series\s*$|:\s.*$", "")
    turn = rf"^\s*(.*\S)\s*,\s*((?:\S+\s+){{1,6}}(?:{'|'.join(_STOP)}))\s*$"
    text = F.regexp_replace(F.regexp_replace(text, turn, "$2 $1"), r"(?<=\p{L})[-‐](?=\p{L})", "")
    tokens = F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\d]+", " "), " "), lambda w: (w != "") & ~w.isin(*_STOP))
    acronym = F.when(F.trim("name").rlike(r"^\p{Lu}{2,}$"), F.lower(F.trim("name")))
    return spellings.select("name", tokens.alias("tokens"), acronym.alias("acronym")).filter(F.size("tokens") > 0)


def venue_variants(spellings: DataFrame, evidence: DataFrame | None = None, least: float = 0.85) -> DataFrame:
    """Pairs ``(name_a, name_b)`` of different spellings of ``spellings(name)`` that mean the same venue, name_a < name_b.

    Significant words must pair up in order, each equal, one the beginning of the other, or within one edit (two from seven
    letters on); an acronym must equal the initials. Word weights grow with rarity. A name in which words are torn
    apart or run together is compared as a whole. ``evidence(name, mark)`` are marks seen with a spelling, such
    as serial numbers: an acronym is only linked where the two share one, if both have any. Repeated spellings count once; nulls have no variants.
    """
    v = parse_venues(written(spellings.filter("name is not null").select("name").distinct())).withColumn("id", F.xxhash64("name"))
    if evidence is not None:
        v = v.join(evidence.filter("mark is not null").groupBy("name").agg(F.collect_set("mark").alias("marks")), "name", "left")
    else:
        v = v.withColumn("marks", F.lit(None).cast("array<string>"))
    v = written(v)
    n, total = F.posexplode("tokens").alias("_p", "w"), v.count()
    df = v.select(F.explode(F.array_distinct("tokens")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("_df"))
    listed = F.sort_array(F.collect_list(F.struct("_p", F.log1p(F.lit(total) / F.col("_df")).alias("_w"))))
    weight = v.select("id", n).join(df, "w").groupBy("id").agg(F.transform(listed, lambda s: s["_w"]).alias("weights"))
    letters = lambda c: F.array_join(F.transform(c, lambda w: F.substring(w, 1, 1)), "")
    v = written(v.join(weight, "id").withColumn("initials", F.coalesce("acronym", letters("tokens"))).withColumn("whole", F.array_join("tokens", "")))
    cols = ("id", "name", "tokens", "acronym", "initials", "whole", "weights", "marks")
    a, b = (v.select(*(F.col(c).alias(f"{c}_{s}") for c in cols)) for s in "ab")
    same = v.select("initials", F.col("id").alias("id_a")).join(v.select("initials", F.col("id").alias("id_b")), "initials").filter("id_a < id_b").select("id_a", "id_b")
    # whole names: rare q-grams first, sets that share at least 60 %
    near = similar_sets(v.select("id", F.array_distinct(F.transform(_grams(F.col("whole"), 3), lambda g: g["gram"])).alias("grams")), 0.6)
    pairs = same.union(near).distinct().join(a, "id_a").join(b, "id_b")
    word = lambda x, y: (
        F.when(x == y, F.lit(1.0))
        .when(F.startswith(x, y) | F.startswith(y, x), F.lit(0.95))
        .when((F.length(x) >= 4) & (F.length(y) >= 4) & _one_edit(x, y), 1 - 1 / F.greatest(F.length(x), F.length(y)))
        .when((F.least(F.length(x), F.length(y)) >= 7) & (F.levenshtein(x, y, 3) >= 0), 1 - 2 / F.greatest(F.length(x), F.length(y)))
        .otherwise(F.lit(0.0))
    )
    likeness = F.zip_with("tokens_a", "tokens_b", word)
    weights = F.zip_with("weights_a", "weights_b", lambda x, y: F.greatest(x, y))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    score = add(F.zip_with(likeness, weights, lambda x, w: x * w)) / add(weights)
    in_order = (F.size("tokens_a") == F.size("tokens_b")) & F.col("acronym_a").isNull() & F.col("acronym_b").isNull()
    # words torn apart or run together: one edit for every four letters, three at most
    torn = F.least(F.lit(3), F.floor(F.least(F.length("whole_a"), F.length("whole_b")) / 4)).cast("int")
    shifted = (F.call_function("levenshtein", F.col("whole_a"), F.col("whole_b"), torn) >= 0) & ~in_order
    shared = F.coalesce(F.arrays_overlap("marks_a", "marks_b"), F.lit(True))
    acronym = (F.col("acronym_a").isNotNull() | F.col("acronym_b").isNotNull()) & shared
    linked = F.when(in_order, (F.array_min(likeness) > 0) & (score >= least)).otherwise(shifted)
    by_letters = acronym & (F.col("initials_a") == F.col("initials_b"))
    # links are exact enough to be followed: an abbreviation and a misspelling meet in the full name
    member = connected_components(pairs.filter(linked | by_letters), "id_a", "id_b").join(v.select("id", "name"), "id")
    x, y = (member.select("component", F.col("name").alias(f"name_{s}")) for s in "ab")
    return x.join(y, "component").filter("name_a < name_b").select("name_a", "name_b")


def similar_sets(sets: DataFrame, least: float) -> DataFrame:
    """Pairs ``(id_a, id_b)`` of ``sets(id, grams)`` whose Jaccard similarity is at least ``least``, by prefix filtering."""
    rows = sets.select("id", F.explode("grams").alias("gram"))
    rarity = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("_df"))
    ordered = rows.join(rarity, "gram").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_df", "gram"))), lambda s: s["gram"]).alias("grams"))
    n = F.size("grams")
    ordered = written(ordered)
    first = ordered.select("id", n.alias("_n"), F.explode(F.slice("grams", F.lit(1), n - F.ceil(n * least).cast("int") + 1)).alias("gram"))
    a, b = (first.select(F.col("id").alias(f"id_{s}"), F.col("_n").alias(f"_{s}"), "gram") for s in "ab")
    met = a.join(b, "gram").filter((F.col("id_a") < F.col("id_b")) & (F.col("_a") >= F.col("_b") * least) & (F.col("_b") >= F.col("_a") * least)).select("id_a", "id_b").distinct()
    x, y = (ordered.select(F.col("id").alias(f"id_{s}"), F.col("grams").alias(f"_{s}")) for s in "ab")
    common = F.size(F.array_intersect("_a", "_b"))
    return met.join(x, "id_a").join(y, "id_b").filter(common >= least * (F.size("_a") + F.size("_b") - common)).select("id_a", "id_b")
