"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

A text becomes a sequence of template words: lower case, without punctuation, and with typed
placeholders for numbers (digits or words), units after numbers, and names (words with a capital first
letter and a small second one that are not common beginnings of sentences; names in a row are one). Windows of ``WINDOW`` template words of documents are
hash-joined with those of the benchmark, so a question asked again with other numbers or names
still meets its original.

Windows of one item that lie on one diagonal (document position minus item position) belong to one copy of
the item. There every slot is a variable by its position, as two equal numbers of a question
seldom mean one thing; but a name that comes again in the item must stand for one name in the document.
Where it stands for several, the value at most positions counts, and windows that hold
another do not. A document is contaminated by an item if the windows left on a diagonal are
``MIN_WINDOWS``, or all of the item's if it has fewer.

Only hashes, positions and keys of texts are joined; slots are looked up afterwards, in the texts that were
hit, so what is shuffled grows with the length of a document and not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressmill.llm.common import materialize, table, text_or_empty

#: Template words in a window, a power of two.
WINDOW = 8
#: Windows on one diagonal: 6 windows of 8 words cover 13 words.
MIN_WINDOWS = 6
#: Words of a window that must not be placeholders.
MIN_LITERALS = 4
#: Benchmark windows, and hits, up to which they are broadcast (about 200 bytes each).
BROADCAST_WINDOWS = 100_000
#: Units that are recognised after a number, in English, German, French and Spanish.
UNITS = (
    "kg g mg t lb lbs oz km m cm mm mi ft in l ml s sec ms min h hr hrs kb mb gb tb mph kmh hz khz mhz ghz w kw v a "
    "second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres "
    "kilometer kilometers kilometre kilometres mile miles foot feet inch inches pound pounds ounce ounces gram grams "
    "kilogram kilograms liter liters litre litres dollar dollars euro euros cent cents percent degree degrees ton tons "
    "sekunde sekunden minuten stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren "
    "metern meile meilen zoll pfund gramm kilogramm tonne tonnen prozent grad "
    "seconde secondes heure heures jour jours semaine semaines mois an ans mètre mètres kilomètre kilomètres "
    "gramme grammes kilogramme kilogrammes tonnes livre livres degré degrés "
    "segundo segundos minuto minutos hora horas día días semana semanas mes meses año años metro metros "
    "kilómetro kilómetros litro litros gramo gramos kilogramo kilogramos tonelada toneladas libra libras grado grados"
).split()
#: Numbers in words. Articles that also mean one are none of them.
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_ONES = "one two three four five six seven eight nine".split()
_ZEHNER = "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
_EINER = "zwei drei vier fünf sechs sieben acht neun".split()
NUMBER_WORDS = [
    *_ONES, *"zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million".split(),
    *_TENS, *(t + o for t in _TENS for o in _ONES),
    *_EINER, *"zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn hundert tausend".split(),
    *_ZEHNER, *(f"{e}und{z}" for z in _ZEHNER for e in ["ein", *_EINER]),
    *"deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille".split(),
    *"dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil".split(),
]
#: Words of these languages that begin sentences and are no names, so their capital says nothing.
STARTERS = (
    "the an this that these those it he she they we you his her their its our your my there here what which who whose whom how when where why "
    "if in on at of for to from by with as and but or so then is are was were do does did can could will would has have had each every all "
    "some many most both after before while during let find given suppose calculate "
    "der die das ein eine einen einem einer dies diese dieser es er sie wir ihr ich was wer wie wo wann warum welche welcher wenn im am auf aus "
    "bei mit nach seit von zu zur zum und aber oder dann ist sind war waren hat haben kann jeder jede alle einige viele "
    "le la les un une des ce cette ces il elle ils elles nous vous je que qui quoi quel quelle comment où quand pourquoi si dans sur pour par "
    "avec et mais ou est sont chaque tous "
    "el los las una unos este esta ella ellos qué quién cuál cómo dónde cuándo por en con para pero es son cada"
).split()
#: Marks of slots, and what joins names in a row.
NUMBER, UNIT, NAME, JOIN = "\u0001", "\u0002", "\u0003", "\u0005"
#: Words from here on are literal.
LITERAL = "\u0004"
_MARKS = NUMBER + UNIT + NAME + LITERAL + JOIN
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—·€£°"
_GLUED = r"([0-9])(\p{L})"
_CAPITAL = r"(^|[^\p{L}\p{N}])(\p{Lu}\p{Ll})"
#: A name's mark before a word that is none.
_STARTER = rf"((?i:{'|'.join(STARTERS)}))([^\p{{L}}]|$)"


def _is_number(word: Column) -> Column:
    return ((word >= "0") & (word < ":")) | word.isin(NUMBER_WORDS)


def _plain_words(text: Column) -> Column:
    clean = F.when(text.rlike(f"[{_MARKS}]"), F.translate(text, _MARKS, " " * len(_MARKS))).otherwise(text)
    clean = F.when(clean.rlike(_GLUED), F.regexp_replace(clean, _GLUED, "$1 $2")).otherwise(clean)
    names = F.regexp_replace(clean, _CAPITAL, f"$1{NAME}$2")
    names = F.regexp_replace(names, NAME + _STARTER, "$1$2")
    names = F.regexp_replace(names, rf"({NAME}\p{{L}}+) (?={NAME})", f"$1{JOIN}")
    words = F.split(F.lower(F.translate(names, _PUNCTUATION, "")), r"[ \t\n\r\f]+")
    return F.filter(words, lambda w: w != "")


def with_template_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces the text by ``words``; those that fill a slot carry the mark of its type in front."""
    out = df.withColumn("words", _plain_words(text_or_empty(F.col(text_col)))).drop(text_col)
    units = [*UNITS, *(NAME + u for u in UNITS)]

    def marked(word: Column, at: Column) -> Column:
        after_number = F.coalesce(_is_number(F.get("words", at - 1)), F.lit(False))
        return F.when(_is_number(word), F.concat(F.lit(NUMBER), word)).when(word.isin(units) & after_number, F.concat(F.lit(UNIT), word)).otherwise(word)

    return out.withColumn("words", F.transform("words", marked))


def _template(word: Column) -> Column:
    return F.when(word < LITERAL, F.substring(word, 1, 1)).otherwise(word)


def _with_windows(df: DataFrame) -> DataFrame:
    """Adds ``hashes``, one for each window of ``words``, by doubling the hashed length."""
    out = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(_template(w))))
    size, length = 1, F.size("words")
    while size < WINDOW:
        left = F.slice("hashes", 1, F.greatest(length - (2 * size - 1), F.lit(0)))
        right = F.slice("hashes", 1 + size, F.greatest(length - (2 * size - 1), F.lit(0)))
        out = out.withColumn("hashes", F.zip_with(left, right, lambda a, b: F.xxhash64(a, b)))
        size *= 2
    return out


def _keyed(rows: DataFrame, text_col: str) -> DataFrame:
    """Adds ``k1 k2``, which tell texts apart: a 64-bit hash, and the length with the CRC."""
    text = text_or_empty(F.col(text_col))
    size = F.shiftleft(F.octet_length(text).cast("long"), 32)
    return rows.select(*[c for c in rows.columns if c != text_col], text.alias("text"), F.xxhash64(text).alias("k1"), (size + F.crc32(text)).alias("k2"))


KEY, COPY = ["k1", "k2"], ["k1", "k2", "item", "t", "diagonal"]


def benchmark_words(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item, t, words)``; ``t`` tells the texts of one id apart."""
    text = text_or_empty(F.col(text_col))
    return with_template_words(benchmark.select(F.col(id_col).cast("long").alias("item"), F.xxhash64(text).alias("t"), text.alias("text"))).distinct()


def benchmark_windows(words: DataFrame) -> DataFrame:
    """``(item, t, at, hash, need)`` of every window with enough literal words."""
    # outer, here and below: else the optimizer adds a filter that computes all words a second time
    at = _with_windows(words).select("item", "t", "words", F.posexplode_outer("hashes").alias("at", "hash")).where("at >= 0")
    literals = F.size(F.filter(F.slice("words", F.col("at") + 1, WINDOW), lambda w: w >= LITERAL))
    at = at.where(literals >= MIN_LITERALS).select("item", "t", "at", "hash")
    need = at.groupBy("item", "t").agg(F.least(F.count("*"), F.lit(MIN_WINDOWS)).alias("need"))
    return at.join(need, ["item", "t"])


def _small(df: DataFrame) -> DataFrame:
    """Marked to be broadcast, if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_WINDOWS else df


def _inconsistent(hits: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """``(k1, k2, item, t, diagonal, at)``: windows that hold the lesser value of a name that comes again in its item."""
    names = items.select("item", "t", F.posexplode_outer("words").alias("p", "asked")).where(F.col("asked").startswith(NAME))
    again = names.groupBy("item", "t", "asked").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    names = materialize(names.join(again, ["item", "t", "asked"]), "names")
    if names.isEmpty():
        return hits.select(*COPY, "at").limit(0)
    met = hits.join(_small(names), ["item", "t"]).where(F.col("p").between(F.col("at"), F.col("at") + WINDOW - 1))
    met = materialize(met.select(*COPY, "p", "asked", (F.col("p") + F.col("diagonal")).alias("pos")).distinct(), "slots")
    there = _small(materialize(met.select(*KEY).distinct(), "hit-texts"))
    words = with_template_words(texts.select(*KEY, "text").join(there, KEY, "left_semi"))
    values = words.select(*KEY, F.posexplode_outer("words").alias("pos", "value")).where(F.col("value").startswith(NAME))
    # distinct before the join: copies of one text give the same values
    found = met.join(values.distinct(), [*KEY, "pos"])
    found = materialize(found.select(*COPY, "p", "asked", "value"), "values")
    votes = found.groupBy(*COPY, "asked", "value").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy(*COPY, "asked").orderBy(F.desc("n"), "value"))
    lesser = votes.withColumn("nth", nth).where("nth > 1").select(*COPY, "asked", "value")
    lost = found.join(lesser, [*COPY, "asked", "value"], "left_semi")
    return lost.select(*COPY, F.explode(F.sequence(F.col("p") - WINDOW + 1, F.col("p"))).alias("at")).distinct()


def _whole_items(words: DataFrame, items: DataFrame) -> DataFrame:
    """``(k1, k2, item, windows, at)`` of ``items(item, words)`` found whole in ``words(k1, k2, words)``.

    For items without a usable window. All template words must be equal, and a name that comes again must stand
    for one name; where fewer than ``MIN_LITERALS`` words are literal the slots must hold the item's own values.
    """
    lengths = [r[0] for r in items.select(F.size("words")).distinct().collect()]
    literals = F.size(F.filter("words", lambda w: w >= LITERAL))
    items = items.select(
        "item", F.col("words").alias("item_words"), F.transform("words", _template).alias("shape"), (literals < MIN_LITERALS).alias("exact")
    )

    def windows(size: int) -> Column:
        made = F.transform("words", lambda w, i: F.struct(i.alias("at"), F.slice("words", i + 1, size).alias("copy")))
        return F.filter(made, lambda c: F.size(c["copy"]) == size)

    at = words.select(*KEY, F.explode_outer(F.concat(*map(windows, lengths))).alias("c")).where("c is not null").select(*KEY, "c.*")
    found = at.withColumn("shape", F.transform("copy", _template)).join(_small(items), "shape")
    filled = F.array_distinct(
        F.filter(F.arrays_zip(F.col("item_words").alias("asked"), F.col("copy").alias("found")), lambda p: p["asked"].startswith(NAME))
    )
    consistent = F.size(F.array_distinct(F.transform(filled, lambda p: p["asked"]))) == F.size(filled)
    same = F.when(F.col("exact"), F.col("copy") == F.col("item_words")).otherwise(consistent)
    return found.where(same).groupBy(*KEY, "item").agg(F.lit(1).cast("long").alias("windows"), F.min("at").alias("at"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """``(id, item, windows, at)``: the documents that hold a benchmark item, and which.

    ``windows`` is the number of item windows on the best diagonal that agree on its names, ``at`` the
    first template word of the item's copy in the document (the least, if several are as
    good). Items without a window of ``MIN_LITERALS`` literal words are found as a whole. Null and empty
    texts match nothing; repeated rows and ids give one row for each id and item, texts of one id being searched each
    on its own; a null id is reported as null; extra columns are ignored; an empty table on either side gives
    an empty result.
    """
    words = materialize(benchmark_words(benchmark, item_col), "items")
    items = materialize(benchmark_windows(words), "item-windows")
    texts = _keyed(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text")), "_text")
    rows = _with_windows(with_template_words(texts.select(*KEY, "text")))
    rows = rows.select(*KEY, F.posexplode_outer("hashes").alias("pos", "hash"))
    hits = rows.join(_small(items), "hash").select(*KEY, "item", "t", "at", "need", (F.col("pos") - F.col("at")).alias("diagonal"))
    hits = materialize(hits.distinct(), "hits")
    good = hits.join(_inconsistent(hits, texts, words), [*COPY, "at"], "left_anti")
    good = good.groupBy(*COPY, "need").agg(F.count("*").alias("windows")).where("windows >= need")
    best = good.select(*KEY, "item", "windows", F.col("diagonal").alias("at"))

    short = words.where(F.size("words") > 0).join(items.select("item", "t").distinct(), ["item", "t"], "left_anti").drop("t").distinct()
    short = materialize(short, "short-items")
    if not short.isEmpty():
        best = best.union(_whole_items(with_template_words(texts.select(*KEY, "text")), short))
    best = best.groupBy(*KEY, "item").agg(F.min(F.struct((-F.col("windows")).alias("w"), "at")).alias("b"))
    best = _small(materialize(best.select(*KEY, "item", "b"), "found"))
    out = texts.select("id", *KEY).join(best, KEY).groupBy("id", "item").agg(F.min("b").alias("b"))
    return out.select("id", "item", (-F.col("b.w")).alias("windows"), F.col("b.at").alias("at"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "windows", F.col("at").alias("at_word"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_words(name: str, table_: str, id_: str) -> str:
    """``with_template_words`` in DuckDB's SQL, as tables ``<name>_p`` and ``<name>_w``."""
    marks = " || ".join(f"chr({ord(c)})" for c in _MARKS)
    t = f"translate(coalesce(text, ''), {marks}, {_quoted(' ' * len(_MARKS))})"
    t = f"regexp_replace({t}, {_quoted(_GLUED)}, '\\1 \\2', 'g')"
    t = f"regexp_replace({t}, {_quoted(_CAPITAL)}, '\\1' || chr(3) || '\\2', 'g')"
    t = f"regexp_replace({t}, chr(3) || {_quoted(_STARTER)}, '\\1\\2', 'g')"
    for _ in range(2):  # a match takes the mark that the next one would begin with
        t = f"regexp_replace({t}, '(' || chr(3) || '\\p{{L}}+) (' || chr(3) || ')', '\\1' || chr(5) || '\\2', 'g')"
    t = f"lower(translate({t}, {_quoted(_PUNCTUATION)}, ''))"
    plain = f"list_filter(regexp_split_to_array({t}, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')"
    numbers = ", ".join(map(_quoted, NUMBER_WORDS))
    units = ", ".join(map(_quoted, UNITS))
    number = lambda w: f"(({w} >= '0' and {w} < ':') or {w} in ({numbers}))"
    marked = f"""case when {number('x')} then chr(1) || x
        when (x in ({units}) or (x[1] = chr(3) and x[2:] in ({units}))) and i > 1 and {number('p[i - 1]')} then chr(2) || x else x end"""
    return f"""{name}_p as (select distinct {id_} as id, coalesce(text, '') as text, {plain} as p from {table_}),
    {name}_w as (select id, text, list_transform(p, lambda x, i: {marked}) as w from {name}_p)"""


def _sql_windows(name: str, table_: str, id_: str) -> str:
    shape = "lambda w: case when w < chr(4) then w[1] else w end"
    return f"""{_sql_words(name, table_, id_)},
    {name}_at as (select distinct id, text, unnest(range(0, greatest(len(w) - {WINDOW - 1}, 0))) as pos, w from {name}_w),
    {name} as (select id, text, pos, w[pos + 1:pos + {WINDOW}] as slots, array_to_string(list_transform(w[pos + 1:pos + {WINDOW}], {shape}), chr(9)) as key from {name}_at)"""


ORACLE_SQL = f"""with {_sql_windows("docs", "documents", "doc_id")}, {_sql_windows("items", "benchmark", "item_id")},
    good as (select * from items where len(list_filter(slots, lambda w: w >= chr(4))) >= {MIN_LITERALS}),
    need as (select id, text, least(count(*), {MIN_WINDOWS}) as need from good group by all),
    hits as (select d.id as doc, d.text as doc_text, i.id as item, i.text as item_text, i.pos, d.pos - i.pos as diagonal, i.slots as asked, d.slots as found
        from docs d join good i using (key)),
    item_names as (select distinct id as item, text as item_text, unnest(w) as asked, unnest(range(0, len(w))) as p from items_w),
    again as (select item, item_text, asked from item_names where asked[1] = chr(3) group by all having count(*) > 1),
    pairs as (select doc, doc_text, item, item_text, pos, diagonal, pos + unnest(range(0, {WINDOW})) as p, unnest(asked) as asked, unnest(found) as found from hits),
    named as (select * from pairs semi join again using (item, item_text, asked)),
    votes as (select doc, doc_text, item, item_text, diagonal, asked, found, count(distinct p) as n from named group by all),
    lesser as (select * from votes qualify row_number() over (partition by doc, doc_text, item, item_text, diagonal, asked order by n desc, found) > 1),
    lost as (select distinct doc, doc_text, item, item_text, diagonal, pos from named semi join lesser using (doc, doc_text, item, item_text, diagonal, asked, found)),
    diagonals as (select doc, item, item_text, doc_text, diagonal, count(distinct pos) as windows
        from hits anti join lost using (doc, doc_text, item, item_text, diagonal, pos) group by all)
select doc as doc_id, item as item_id, windows, diagonal::int as at_word from diagonals join need on item = id and item_text = text where windows >= need
qualify row_number() over (partition by doc, item order by windows desc, diagonal) = 1"""
