"""Benchmark decontamination by template windows, in DataFrame operations only.

Words lose their case and outer punctuation; numbers, names and units become typed placeholders.
Documents and benchmark items are joined on hashes of windows of such words, in two steps. A sieve
over all documents takes cheap forms of the text (a few passes of regular expressions) and keeps
the documents that share several windows with an item. Windows of these, with the places and values
of their placeholders, are then judged by occurrence. What the placeholders stand for must agree:
where a question was given new numbers or names, values of the item and their counterparts in the
document are mapped one to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import joined, stored

#: Words that are units after a number (fixed values).
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "yd", "yards", "mile", "miles", "meter", "meters", "metre", "metres",
    "mg", "g", "kg", "lb", "lbs", "oz", "gram", "grams", "pound", "pounds", "ton", "tons", "tonnes", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "percent", "dollar", "dollars", "cent", "cents", "euro", "euros", "usd", "eur", "degree", "degrees", "mph", "kmh", "watts", "volts",
)

#: Rows of a table up to this many are broadcast (some 100 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 500_000

#: The band of hits in the whole document.
_WHOLE = -(1 << 60)


#: Stands before a word that begins a sentence, so that its capital letter names nobody.
_START = "\u0002"

_NUMBER = rf"^{_START}?[+-]?[0-9]+([.,:/-][0-9]+)*(st|nd|rd|th)?$"
_QUANTITY = rf"^{_START}?[0-9]+([.,][0-9]+)*\p{{L}}+$"


def _words(text: Column) -> Column:
    """Words without outer punctuation, in their case; two passes over the text, none over each word.

    The spaces around the text make its own ends separators, so that an empty part stands at each end.
    """
    marked = F.regexp_replace(text, r"[.!?:]+[\"')\]]*\s+[^\p{L}\p{N}]*", f" {_START}")
    outer = r"[^\p{L}\p{N}" + _START + "]"
    return F.split(F.concat(F.lit(" "), F.coalesce(marked, F.lit("")), F.lit(" ")), rf"{outer}*\s+{outer}*")


def _plain(word: Column) -> Column:
    return F.lower(F.ltrim(word, F.lit(_START)))


def _templates(words: Column, text: Column) -> Column:
    """The template of each word: itself in lower case, or a placeholder."""

    def named(w: Column, i: Column) -> Column:
        return F.when(F.lower(w) == w, F.ltrim(w, F.lit(_START))).when((i > 0) & w.rlike(r"^\p{Lu}\p{Ll}"), "<name>").otherwise(_plain(w))

    def typed(w: Column, i: Column) -> Column:
        digit = w.rlike("[0-9]")
        after_number = (i > 0) & F.get(words, i - 1).rlike(_NUMBER)
        return (
            F.when(digit & w.rlike(_NUMBER), "<num>")
            .when(digit & w.rlike(_QUANTITY), "<qty>")
            .when(_plain(w).isin(*UNITS) & after_number, "<unit>")
            .otherwise(named(w, i))
        )

    return F.when(text.rlike("[0-9]"), F.transform(words, typed)).otherwise(F.transform(words, named))


def _typed(rows: DataFrame) -> DataFrame:
    """``(id, words, template, slotted, starts, opened)``, each a column of its own: lambdas below look into them.

    ``starts`` are the places of capitalised words that begin a sentence, and ``opened`` is the
    template in which these are names too (null without such words).
    """
    rows = rows.select("id", "text", _words(F.col("text")).alias("parts"))
    rows = rows.select("id", "text", F.slice("parts", 2, F.size("parts") - 2).alias("words"))
    rows = rows.select("id", "words", _templates(F.col("words"), F.col("text")).alias("template"))

    def opens(w: Column, i: Column) -> Column:
        return (w.startswith(_START) | (i == 0)) & w.rlike(rf"^{_START}?\p{{Lu}}\p{{Ll}}")

    starts = F.array_compact(F.transform("words", lambda w, i: F.when(opens(w, i), i)))
    rows = rows.withColumn("slotted", F.exists("template", lambda t: t.startswith("<"))).withColumn("starts", starts)
    begins = F.transform("words", lambda w, i: F.when(opens(w, i), "<name>").otherwise(F.get(F.col("template"), i)))
    return rows.withColumn("opened", F.when(F.size("starts") > 0, begins))


#: A window of few literal words is widened up to this many words until it has enough of them.
_WIDEST = 16

_WINDOWS = "array<struct<at:int,hash:bigint,slots:array<string>,width:int,sure:boolean>>"


def _windows(length: int, *, open_too: bool = False, by_value: bool = False) -> Column:
    """``(at, hash, slots, width, sure)`` of every window.

    One with few literal words is widened to the right until it has enough; where the text ends
    before (not ``sure``) its values must agree. With ``open_too`` the windows in which a word
    begins a sentence are given a second time, with that word as a name. With ``by_value`` every
    window that is widened is given by its values too: an item may end where a document goes on.
    """
    words, need = F.col("words"), length - length // 2
    no_slots = F.lit(None).cast("array<string>")

    def given(template: Column, places: Column, plain: bool) -> Column:
        def hashed(i: Column) -> Column:
            return F.xxhash64(*(F.get(template, i + j) for j in range(length)))

        def literal(i: Column) -> Column:
            return F.struct(i.alias("at"), hashed(i).alias("hash"), no_slots.alias("slots"), F.lit(length).alias("width"), F.lit(True).alias("sure"))

        def slotted(i: Column) -> Column:
            slot = [F.get(template, i + j).startswith("<") for j in range(length)]
            value = [_plain(F.get(words, i + j)) for j in range(length)]
            n = sum((s.cast("int") for s in slot), F.lit(0))
            slots = F.array_compact(F.array(*(F.when(s, v) for s, v in zip(slot, value))))
            reach = F.sequence(i, F.least(i + _WIDEST, F.size("words")) - 1)
            last = F.get(F.filter(reach, lambda j: ~F.get(template, j).startswith("<")), F.lit(need - 1))
            wide_slots = F.transform(F.filter(F.sequence(i, last), lambda j: F.get(template, j).startswith("<")), lambda j: _plain(F.get(words, j)))
            values = F.xxhash64(F.lit("values"), *value)
            wide = last.isNotNull()
            heavy = F.struct(
                i.alias("at"),
                F.when(wide, F.xxhash64(F.lit("wide"), F.slice(template, i + 1, last - i + 1))).otherwise(values).alias("hash"),
                F.when(wide, wide_slots).otherwise(slots).alias("slots"),
                F.when(wide, last - i + 1).otherwise(F.lit(length)).cast("int").alias("width"),
                wide.alias("sure"),
            )
            light = F.struct(i.alias("at"), hashed(i).alias("hash"), F.when(n > 0, slots).otherwise(no_slots).alias("slots"), F.lit(length).alias("width"), F.lit(True).alias("sure"))
            return F.when(n > length - need, heavy).otherwise(light)

        def valued(i: Column) -> Column:
            slot = [F.get(template, i + j).startswith("<") for j in range(length)]
            value = [_plain(F.get(words, i + j)) for j in range(length)]
            n = sum((x.cast("int") for x in slot), F.lit(0))
            slots = F.array_compact(F.array(*(F.when(x, v) for x, v in zip(slot, value))))
            one = F.struct(i.alias("at"), F.xxhash64(F.lit("values"), *value).alias("hash"), slots.alias("slots"), F.lit(length).alias("width"), F.lit(False).alias("sure"))
            return F.when(n > length - need, one)

        with_slots = F.transform(places, slotted)
        if by_value:
            with_slots = F.concat(with_slots, F.array_compact(F.transform(places, valued)))
        return F.when(F.col("slotted"), with_slots).otherwise(F.transform(places, literal)) if plain else with_slots

    every = given(F.col("template"), F.sequence(F.lit(0), F.size("words") - length), True)
    if open_too:
        back = F.when(F.col("slotted"), F.lit(_WIDEST - 1)).otherwise(F.lit(length - 1))
        about = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(F.greatest(F.lit(0), s - back), F.least(s, F.size("words") - length)))))
        second = given(F.col("opened"), about, False)
        every = F.when(F.size("starts") > 0, F.concat(every, second)).otherwise(every)
    return F.when(F.size("words") >= length, every)


#: In the sieve, a number with its unit and a capitalised word (private-use characters).
_A_NUMBER, _A_NAME = "", ""
#: The share of the windows that a judged occurrence must have which is enough for the sieve: a form
#: may miss some that another has, and the judgement cuts words a little differently.
_SIEVE_SHARE = 3


def _forms(rows: DataFrame) -> DataFrame:
    """``(id, form, words)``: each text in up to three forms, all in lower case, an empty word at each end.

    Form 0 has marks for numbers and capitalised words, form 1 for numbers, form 2 none (given only
    to texts with digits: without them it is form 1). Words that the judgement takes as equal are
    equal in form 0 if both stand for a name, and in form 1 if their letters are the same in
    whatever case; in form 2 the numbers of a text without other words are.
    """
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    numbers = rf"[0-9]+(?:[.,:/-][0-9]+)*(?:\p{{L}}+|[^\p{{L}}\p{{N}}]{{0,3}}(?i:{units})(?![\p{{L}}\p{{N}}]))?"
    names = r"\p{Lu}\p{Ll}[\p{L}\p{N}]*(?:['’-][\p{L}\p{N}]+)*"
    text = F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit(" "))
    rows = rows.select("id", text.alias("text"))
    rows = rows.select("id", "text", F.col("text").rlike("[0-9]").alias("digits"), F.regexp_replace("text", numbers, _A_NUMBER).alias("numbered"))

    def words(x: Column) -> Column:
        return F.split(F.lower(x), rf"[^\p{{L}}\p{{N}}{_A_NUMBER}{_A_NAME}]+")

    forms = F.array(words(F.regexp_replace("numbered", names, _A_NAME)), words(F.col("numbered")), F.when(F.col("digits"), words(F.col("text"))))
    return rows.select("id", F.posexplode(forms).alias("form", "words"))


def _hash_at(length: int) -> Column:
    return F.xxhash64(F.lit(length), *(F.get("words", F.col("at") + j) for j in range(length)))


def _sieved(rows: DataFrame, benchmark: DataFrame, window: int, similarity: float, passage_words: int) -> DataFrame:
    """``(id, item)``: documents that may be contaminated by an item, found in one pass over all documents.

    A pair stays if, in one form of the item, the document has a third of the windows that the
    judgement asks for. Of forms 0 and 1 windows with fewer than two literal words don't count,
    unless the item has no others.
    """
    items = _forms(benchmark).withColumn("length", F.least(F.size("words") - 2, F.lit(window))).where("length > 0")
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most ``window`` of them
    at = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") - 1)).alias("at")
    own = items.select("id", "form", "words", "length", at)
    literal = F.size(F.filter(F.slice("words", F.col("at") + 1, F.col("length")), lambda w: ~F.substring(w, 1, 1).isin(_A_NUMBER, _A_NAME)))
    hashed = F.coalesce(*(F.when(F.col("length") == n, _hash_at(n)) for n in lengths or [window]))
    own = own.select(F.col("id").alias("item"), "form", F.col("at").alias("item_at"), "length", literal.alias("literal"), hashed.alias("hash"))
    of_item = Window.partitionBy("item", "form")
    most = F.max("literal").over(of_item)
    own = own.withColumn("counts", (F.col("form") == 2) | (F.col("literal") >= F.least(F.lit(2), F.col("length"), F.greatest(F.lit(1), most))))
    asked = F.least(F.ceil(F.count("*").over(of_item) * F.lit(similarity)), F.lit(max(1, passage_words - window + 1))) - F.count_if(~F.col("counts")).over(of_item)
    own = own.withColumn("need", F.greatest(F.lit(1), F.ceil(asked / _SIEVE_SHARE)))
    wanted = stored(own.where("counts").select("item", "form", "item_at", "hash", "need"), "sieve")
    small = wanted.count() <= MOST_BROADCAST

    # The places are exploded and not the windows: the words stay one array in the generated code.
    least = min(lengths, default=window)
    places = F.when(F.size("words") - 2 >= least, F.sequence(F.lit(1), F.size("words") - least - 1))
    places = _forms(rows).select("id", "words", F.explode(places).alias("at"))
    hashes = [_hash_at(n) for n in lengths]
    found = places.select("id", hashes[0].alias("hash") if len(hashes) == 1 else F.explode(F.array(*hashes)).alias("hash"))
    hits = joined(found, wanted, "hash", small=small)
    # Counted within a row's task first: all windows of a text lie together.
    hits = hits.groupBy("id", "item", "form", "item_at", "need").agg(F.lit(1).alias("met")).groupBy("id", "item", "form", "need").agg(F.sum("met").alias("met"))
    return hits.where("met >= need").select("id", "item").distinct()


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 5,
    similarity: float = 0.8,
    passage_words: int = 13,
    agreement: float = 0.8,
) -> DataFrame:
    """``(id, item, containment, longest_passage, slot_agreement, kind)`` of every contaminated pair.

    A document is contaminated by an item if an occurrence (or the document as a whole) holds at
    least ``similarity`` of the item's windows, or an occurrence holds ``passage_words`` consecutive
    words of it, and if placeholder values agree there: of all the places where an item's value is
    met, at least the share ``agreement`` has that value's most frequent counterpart, and this
    counterpart has no more frequent value (1 without placeholders). ``kind`` is ``exact`` or, where
    counterparts differ from the values, ``reparameterised``. Items of fewer words than a window
    are one window; items without words match nothing. Null texts have no words; rows with null
    ids can't be named and are left out; repeated ids count as one document. No columns but the
    named ones are read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    items = _typed(benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text")).where("id is not null"))
    items = stored(items.withColumn("length", F.least(F.size("words"), F.lit(window))).where("length > 0"), "items")
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most ``window`` of them
    item_windows = None
    for n in lengths:
        own = items.where(F.col("length") == n).select("id", F.explode(_windows(n, open_too=n == window)).alias("x"))
        own = own.select(F.col("id").alias("item"), F.col("x.at").alias("item_at"), F.col("x.hash").alias("hash"), F.col("x.slots").alias("item_slots"), "x.width", "x.sure").distinct()
        item_windows = own if item_windows is None else item_windows.union(own)
    if item_windows is None:
        id_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
        shape = f"`{id_col}` {id_type}, `{item_col}` {item_type}, containment double, longest_passage int, slot_agreement double, kind string"
        return docs.sparkSession.createDataFrame([], shape)
    # Windows at an item's end that can't be widened don't count, unless they are most of the item.
    item_windows = stored(item_windows, "item-windows")
    small = item_windows.count() <= MOST_BROADCAST
    places = item_windows.groupBy("item", "item_at").agg(F.max("sure").alias("sure"), F.max(F.col("item_at") + F.col("width")).alias("end"))
    totals = places.groupBy("item").agg(F.count("*").alias("all"), F.count(F.when(F.col("sure"), 1)).alias("sure_ones"), F.max("end").alias("item_words"))
    most = F.col("sure_ones") * 2 >= F.col("all")
    totals = totals.select("item", "item_words", most.alias("most_sure"), F.when(most, F.col("sure_ones")).otherwise(F.col("all")).alias("windows"))
    places = joined(places, totals, "item", small=small).select("item", "item_at", "item_words", (F.col("sure") | ~F.col("most_sure")).alias("counts"))
    item_windows = stored(joined(item_windows, places, ["item", "item_at"], small=small).drop("sure"), "item-windows")
    asked = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("text")).where("id is not null")
    candidates = _sieved(rows, asked, window, similarity, passage_words)
    candidates = stored(candidates.select("id").distinct(), "candidates")
    rows = joined(rows, candidates, "id", "left_semi", small=candidates.count() <= MOST_BROADCAST)

    typed = _typed(rows).withColumn("row", F.monotonically_increasing_id())
    found = F.concat(*(F.coalesce(_windows(n, open_too=n == window, by_value=True), F.array().cast(_WINDOWS)) for n in lengths))
    exploded = typed.select("id", "row", F.explode(found).alias("x")).select("id", "row", "x.at", "x.hash", "x.slots")
    met = joined(exploded, item_windows, "hash", small=small)
    met = stored(met.select("id", "row", "item", "item_at", (F.col("at") - F.col("item_at")).alias("diagonal"), "width", "counts", "item_words", "slots", "item_slots"), "met")

    # A run is of consecutive words of the document: windows on one diagonal that touch.
    on_diagonal = Window.partitionBy("id", "row", "item", "diagonal").orderBy("item_at")
    reach = F.max(F.col("item_at") + F.col("width")).over(on_diagonal.rowsBetween(Window.unboundedPreceding, -1))
    runs = met.select("id", "row", "item", "diagonal", "item_at", "width").distinct().withColumn("apart", F.coalesce((F.col("item_at") > reach).cast("int"), F.lit(1)))
    runs = runs.withColumn("island", F.sum("apart").over(on_diagonal)).groupBy("id", "row", "item", "diagonal", "island")
    runs = runs.agg((F.max(F.col("item_at") + F.col("width")) - F.min("item_at")).alias("run")).groupBy("id", "row", "item", "diagonal").agg(F.max("run").alias("run"))

    # An occurrence is a band of near diagonals, half an item wide at most: copies one after another
    # never share a band, and what drifts by up to a quarter of the item lies in one. The whole
    # document is one more (band and row null), by its containment only.
    step = F.greatest(F.lit(1), F.floor(F.col("item_words") / 4))
    band = F.floor(F.col("diagonal") / step)
    bands = F.explode(F.array(band, band + 1, F.lit(None).cast("bigint"))).alias("band")
    whole = F.col("band").isNull()
    near = joined(met, runs, ["id", "row", "item", "diagonal"]).select("*", bands).withColumn("row", F.when(~whole, F.col("row")))
    # Of the places where a window is met in an occurrence, those on its longest run's diagonal speak for it.
    occurrence = ["id", "item", "row", "band"]
    near = near.withColumn("main", F.max(F.struct("run", "diagonal")).over(Window.partitionBy(*occurrence))["diagonal"])
    off = F.abs(F.col("diagonal") - F.col("main"))
    near = near.withColumn("least", F.min(off).over(Window.partitionBy(*occurrence, "item_at"))).where(whole | (off == F.col("least")))
    near = near.withColumn("band", F.coalesce("band", F.lit(_WHOLE))).withColumn("row", F.coalesce("row", F.lit(-1)))
    near = stored(near.drop("main", "least"), "occurrences")

    pairs = near.groupBy(*occurrence).agg(F.countDistinct(F.when(F.col("counts"), F.col("item_at"))).alias("covered"), F.max("run").alias("run"))
    pairs = joined(pairs, totals, "item", small=small).select(*occurrence, (F.col("covered") / F.col("windows")).alias("containment"), F.col("run").cast("int").alias("longest_passage"))
    pairs = pairs.where((F.col("containment") >= similarity) | ((F.col("longest_passage") >= passage_words) & (F.col("band") != _WHOLE)))

    slots = joined(near.where("slots is not null and item_slots is not null and size(slots) = size(item_slots)"), pairs.select(*occurrence), occurrence, "left_semi")
    slots = slots.select(*occurrence, F.explode(F.arrays_zip("item_slots", "slots")).alias("x"))
    slots = slots.groupBy(*occurrence, F.col("x.item_slots").alias("value"), F.col("x.slots").alias("counterpart")).agg(F.count("*").alias("n"))
    weight = F.struct("n", F.col("value") == F.col("counterpart"), "value", "counterpart")
    of_value = F.max(weight).over(Window.partitionBy(*occurrence, "value")) == weight
    of_counterpart = F.max(weight).over(Window.partitionBy(*occurrence, "counterpart")) == weight
    slots = slots.withColumn("top", of_value).withColumn("mutual", F.col("top") & of_counterpart)
    agreed = F.sum(F.when(F.col("mutual"), F.col("n")).otherwise(0)) / F.sum("n")
    slots = slots.groupBy(*occurrence).agg(agreed.alias("slot_agreement"), F.bool_and((F.col("value") == F.col("counterpart")) | ~F.col("top")).alias("same"))
    out = joined(pairs, slots, occurrence, "left").withColumn("slot_agreement", F.coalesce("slot_agreement", F.lit(1.0))).withColumn("same", F.coalesce("same", F.lit(True)))
    # The best occurrence that passes speaks for the pair.
    out = out.where(F.col("slot_agreement") >= agreement).groupBy("id", "item").agg(F.max(F.struct("same", "containment", "slot_agreement", "longest_passage")).alias("best")).select("id", "item", "best.*")
    return out.select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        "containment",
        "longest_passage",
        "slot_agreement",
        F.when(F.col("same"), "exact").otherwise("reparameterised").alias("kind"),
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that no benchmark item contaminates; rows without an id stay."""
    bad = stored(contamination(docs, benchmark, id_col=id_col, **options).select(id_col).distinct(), "contaminated")
    return joined(docs, bad, id_col, "left_anti", small=bad.count() <= MOST_BROADCAST).select(*docs.columns)
