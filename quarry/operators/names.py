"""File names for many questions, by an index of n-grams: which names hold a word of the question, and which stand in it.

Scoring every name for every question is a product of both tables. But a name that holds a word holds all of its trigrams, and a question that holds a name's stem holds all trigrams of the stem: so a word meets
names by the rarest of its trigrams, and a stem meets questions by the rarest of its own, both by equality. The same holds for longer grams, of SIZE characters. Containment is verified. Words and stems
of at most SIZE characters meet as they are.

A frequent word is in many names and many questions, so pairs that share a word grow with the product of both. Only a few names of each question are wanted, though: of all names that hold the same words of a question, the first ones
by score and order come before the others, whatever else they hold. So the first names are taken once for each set of words (`by_sets`), and each question of few words looks up its own sets. Questions of more words
than `WORDS` are summed up over all names (`by_sums`): their number should be bounded. Names that a question spells out have a score of their own and are always candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import mentions, question_tokens, score_file_name, stem, strip
from quarry.operators.facets import RECENT
from quarry.runtime import materialise

SIZE = 8
#: Words of a question whose sets are all looked up.
WORDS = 4


def grams(text: Column, size: int) -> Column:
    """The distinct substrings of so many characters."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def all_grams(text: Column) -> Column:
    """Those of one to SIZE characters."""
    return F.concat(*[grams(text, n) for n in range(1, SIZE + 1)])


def own_grams(text: Column) -> Column:
    """Those of SIZE characters, or a shorter text itself."""
    return F.when(F.length(text) >= SIZE, grams(text, SIZE)).otherwise(F.array(text))


def contained(parts: DataFrame, wholes: DataFrame) -> DataFrame:
    """(part, whole): all pairs of different parts (part) and wholes (whole) where the part, which is not empty, is in the whole."""
    found = wholes.select("whole").distinct().select("whole", F.explode(all_grams(F.col("whole"))).alias("gram"))
    index = materialise(found, "grams")
    often = index.groupBy("gram").agg(F.count("*").alias("n"))
    mine = parts.where("part <> ''").select("part").distinct().select("part", F.explode(own_grams(F.col("part"))).alias("gram"))
    # A gram that no whole has rules its part out.
    rarest = mine.join(often, "gram", "left").groupBy("part").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least"))
    probes = rarest.where("least.n > 0").select("part", "least.gram")
    return probes.join(index, "gram").where(F.contains("whole", F.col("part"))).select("part", "whole")


def holding(names: DataFrame, tokens: DataFrame) -> DataFrame:
    """(part, name, updated_at, weight): the names that hold each of the tokens (part), with what the token adds to a score."""
    lowered = names.select("name", "updated_at", F.lower("name").alias("whole"))
    weight = F.when(F.contains(stem(F.col("whole")), F.col("part")), 3).otherwise(1)
    return contained(tokens, lowered).join(lowered, "whole").select("part", "name", "updated_at", weight.alias("weight"))


def _first(held: DataFrame, by: list[str], limit: int) -> DataFrame:
    """The first names of each group by weight, then in the order of suggestions: a group may be large, and the limit holds on the map side."""
    order = Window.partitionBy(*by).orderBy(F.desc("weight"), "updated_at", "name")
    return held.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") <= limit).select(*by, "name")


def by_sets(held: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """(query_id, name): from held names and questions (query_id, tokens) of at most WORDS tokens, the first names of each set of a question's words.

    Words are in the order of rarity. Sets of two are met by the pairs of each name's own words, larger ones by the pair of their rarest words.
    """
    often = held.groupBy("part").agg(F.count("*").alias("n"))
    words = asked.select("query_id", F.explode("tokens").alias("part")).join(often, "part")
    rarest = words.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]).alias("p"))
    subsets = F.expr("explode(transform(sequence(1, shiftleft(1, size(p)) - 1), m -> filter(p, (x, i) -> shiftright(m, i) % 2 = 1)))")
    sets = materialise(rarest.select("query_id", subsets.alias("set")), "sets")
    wanted = materialise(sets.select("set").distinct(), "wanted")
    found = [_first(held.join(wanted.where("size(set) = 1").select(F.col("set")[0].alias("part"), "set"), "part"), ["set"], limit)]
    # The words of a name that are in a set with another one, and their pairs.
    several = wanted.where("size(set) > 1")
    useful = several.select(F.explode("set").alias("part")).distinct().join(often, "part")
    own = held.join(useful, "part").groupBy("name", "updated_at").agg(F.array_sort(F.collect_list(F.struct("n", "part", "weight"))).alias("own"))
    pairs = own.select("name", "updated_at", "own", F.posexplode("own").alias("i", "a")).select("name", "updated_at", "a", F.explode(F.slice("own", F.col("i") + 2, F.size("own"))).alias("b"))
    two = several.select("set", F.col("set")[0].alias("first"), F.col("set")[1].alias("second"))
    met = pairs.select("name", "updated_at", F.col("a.part").alias("first"), F.col("b.part").alias("second"), (F.col("a.weight") + F.col("b.weight")).alias("weight"))
    met = materialise(met.join(two.select("first", "second").distinct(), ["first", "second"]), "met")
    found.append(_first(met.join(two.where("size(set) = 2"), ["first", "second"]), ["set"], limit))
    low = F.lower("name")
    more = met.join(two.where("size(set) > 2"), ["first", "second"]).where(F.forall("set", lambda t: F.contains(low, t)))
    added = F.aggregate(F.slice("set", 3, WORDS), F.lit(0), lambda total, t: total + F.when(F.contains(stem(low), t), 3).otherwise(1))
    found.append(_first(more.withColumn("weight", F.col("weight") + added), ["set"], limit))
    return sets.join(found[0].unionByName(found[1]).unionByName(found[2]), "set").select("query_id", "name")


def by_sums(held: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """(query_id, name): from held names and questions (query_id, tokens), the first names of each question by the sum over its words. A name's words are dealt to one task, which adds up all questions."""
    words = asked.select("query_id", F.explode("tokens").alias("part"))
    mine = held.join(F.broadcast(words.select("part").distinct()), "part").repartition("name")
    summed = mine.join(F.broadcast(words), "part").groupBy("name", "query_id").agg(F.first("updated_at").alias("updated_at"), F.sum("weight").alias("weight"))
    return _first(summed, ["query_id"], limit)


def candidates(names: DataFrame, questions: DataFrame, limit: int) -> DataFrame:
    """(query_id, name): pairs among which are the first `limit` names of each question, from names (name, updated_at) and questions (query_id, text, tokens)."""
    held = materialise(holding(names, questions.select(F.explode("tokens").alias("part"))), "held")
    few = F.size("tokens") <= WORDS
    words = by_sets(held, questions.where(few), limit).unionByName(by_sums(held, questions.where(~few), limit))
    lowered = names.select("name", stem(F.lower("name")).alias("part"))
    asked = questions.select("query_id", F.lower("text").alias("whole"))
    named = contained(lowered, asked).join(lowered, "part").join(asked, "whole").select("query_id", "name")
    return words.unionByName(named).distinct()


def suggest_all(names: DataFrame, questions: DataFrame, limit: int = 8) -> DataFrame:
    """(query_id, name, score, message, rank): as facets.suggest for each question (query_id, text) that is not blank, over names (name, updated_at) that differ."""
    asked = questions.select("query_id", strip(F.col("text")).alias("text")).where("text <> ''")
    # Written, so that a question is cut once and not for each of its names.
    asked = materialise(asked.select("query_id", "text", question_tokens(F.col("text")).alias("tokens"), mentions(F.col("text")).alias("mentioned")), "questions")
    pairs = candidates(names, asked, limit).join(names.select("name", "updated_at"), "name").join(asked, "query_id")
    score = score_file_name(F.col("text"), F.col("name"), F.col("tokens")) + F.when(F.array_contains("mentioned", F.lower("name")), 50).otherwise(0)
    scored = pairs.select("query_id", "name", "updated_at", score.alias("score")).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "updated_at", "name")
    best = materialise(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "name", "score", F.lit(None).cast("string").alias("message"), "rank"), "suggested")
    latest = [r["name"] for r in names.orderBy(F.desc("updated_at"), "name").limit(limit).collect()]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(0).alias("score"), F.lit(RECENT).alias("message"), F.lit(i + 1).alias("rank")) for i, n in enumerate(latest)])
    none = asked.select("query_id").join(best.select("query_id").distinct(), "query_id", "left_anti")
    return best.unionByName(none.select("query_id", F.inline(rows))) if latest else best
