"""Typed tables read from the node table of script text: people, places, names, traits, events, decisions.

Each table is one grouped pass over the blocks that define its rows and the nodes below them, so that texts are parsed once,
nothing is gathered and every plan stays inside the JVM. Of a repeated key the first
value counts. Contents without such blocks give no rows; a key that is missing gives null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys of a trait's numbers.
TRAIT_NUMBERS = (
    "diplomacy", "martial", "stewardship", "intrigue", "learning", "prowess", "health", "fertility", "attraction_opinion",
    "same_opinion", "opposite_opinion", "vassal_opinion", "general_opinion", "clergy_opinion", "dynasty_opinion",
    "monthly_piety", "monthly_prestige", "stress_gain_mult", "stress_loss_mult",
)
# End of fixed values.


def _only_digits(text: Column) -> Column:
    return (F.length(text) > 0) & (F.translate(text, "0123456789", "") == "")


def _number(text: Column) -> Column:
    return F.when(_only_digits(text), text.try_cast("long"))


def blocks(tree: DataFrame, key: str, keep: Column) -> DataFrame:
    """The top-level blocks that define rows: content key, block (node id), name, line."""
    return tree.where((F.col("depth") == 0) & (F.col("node_type") == "block") & keep).select(key, F.col("node_id").alias("block"), F.col("key").alias("name_of_block"), "line")


def _defined(tree: DataFrame, key: str, keep: Column, names: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """The blocks of ``blocks`` with the first value of each name among their direct children, and all values of each of
    ``lists``, in order."""
    is_block = (F.col("depth") == 0) & (F.col("node_type") == "block") & keep
    is_field = (F.col("depth") == 1) & (F.col("node_type") == "assignment") & F.col("key").isin(*names, *lists)
    # A path ends in [i] from a key's second occurrence on.
    first = is_field & ~F.col("path").endswith("]")
    # Only what is asked is sent, and the rows are dealt by block before they are reduced: maxima of strings are taken in
    # sorted rows, which would else be all nodes of a task's texts.
    asked = [F.when(is_block, F.col("key")).alias("name_of_block"), F.when(is_block, F.col("line")).alias("line")]
    asked += [F.when((F.col("key") == n) & first, F.col("value")).alias(n) for n in names]
    asked += [F.when(is_field & (F.col("key") == n), F.struct("pos", "value")).alias(n) for n in lists]
    rows = tree.where(is_block | is_field).select(key, F.col("top_id").alias("block"), *asked).repartition(key, "block")
    every = [F.transform(F.sort_array(F.collect_list(n)), lambda x: x["value"]).alias(n) for n in lists]
    own = [F.max(n).alias(n) for n in ("name_of_block", "line", *names)]
    return rows.groupBy(key, "block").agg(*own, *every).where("name_of_block IS NOT NULL")


def characters(tree: DataFrame, key: str = "digest") -> DataFrame:
    """Blocks named by a number: character_id, name, culture, religion, dynasty_id, father_id, mother_id, and the dates of
    the first dated blocks that hold birth = yes and death = yes. An id that is no whole number is null."""
    people = _defined(tree, key, _only_digits(F.col("key")), ["name", "culture", "religion", "dynasty", "father", "mother"])
    date = F.get("ancestors", F.lit(1))
    dated = tree.where((F.col("depth") == 2) & F.col("key").isin("birth", "death") & (F.col("value") == "yes") & (F.size(F.split(date, "[.]")) == 3))
    at = lambda what: F.min(F.when(F.col("key") == what, F.struct("node_id", date.alias("date"))))["date"].alias(f"{what}_date")
    dates = dated.groupBy(key, F.col("top_id").alias("block")).agg(at("birth"), at("death"))
    ids = [_number(F.col(c)).alias(f"{c}_id") for c in ("dynasty", "father", "mother")]
    return people.join(dates, [key, "block"], "left").select(key, F.col("name_of_block").try_cast("long").alias("character_id"), "name", "culture", "religion", *ids, "birth_date", "death_date", "line")


def provinces(tree: DataFrame, key: str = "digest") -> DataFrame:
    """Blocks named by a number: province_id, name (a placeholder, as history has none), culture, religion, holding_type."""
    found = _defined(tree, key, _only_digits(F.col("key")), ["culture", "religion", "holding"])
    return found.select(key, F.col("name_of_block").try_cast("long").alias("province_id"), F.concat(F.lit("province_"), "name_of_block").alias("name"), "culture", "religion", F.col("holding").alias("holding_type"), "line")


def names(tree: DataFrame, key: str = "digest") -> DataFrame:
    """Distinct names of name lists: name_list_id, name, gender. A number in front of a list of names is a weight and
    gives its block's names."""
    inside = F.get("ancestors", F.lit(1)).isin("male_names", "female_names") & F.get("ancestors", F.lit(0)).startswith("name_list_")
    own = tree.where(inside & (F.col("node_type") == "value"))
    gender = F.when(F.get("ancestors", F.lit(1)) == "male_names", "male").otherwise("female")
    return own.select(key, F.get("ancestors", F.lit(0)).alias("name_list_id"), F.col("value").alias("name"), gender.alias("gender")).distinct()


def holy_sites(tree: DataFrame, key: str = "digest") -> DataFrame:
    """Blocks with a county: site_key, county, barony, flag."""
    found = _defined(tree, key, F.col("key").isNotNull(), ["county", "barony", "flag"]).where("county IS NOT NULL")
    return found.select(key, F.col("name_of_block").alias("site_key"), "county", "barony", "flag", "line")


def dynasties(tree: DataFrame, key: str = "digest") -> DataFrame:
    """Blocks named by a number: dynasty_id, name_key, prefix, culture."""
    found = _defined(tree, key, _only_digits(F.col("key")), ["name", "prefix", "culture"])
    return found.select(key, F.col("name_of_block").try_cast("long").alias("dynasty_id"), F.col("name").alias("name_key"), "prefix", "culture", "line")


def traits(tree: DataFrame, key: str = "digest") -> DataFrame:
    """Blocks as traits: name, category, trait_group, level, four flags (false unless yes), flags and opposites (all values,
    in order), modifiers (map from key to its text)."""
    found = _defined(tree, key, F.col("key").isNotNull(), ["category", "group", "level", "genetic", "physical", "health_trait", "fame", *TRAIT_NUMBERS], ["flag", "opposite"])
    yes = lambda c, name: F.coalesce(F.col(c) == "yes", F.lit(False)).alias(name)
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in TRAIT_NUMBERS])
    every = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    return found.select(
        key, F.col("name_of_block").alias("name"), "category", F.col("group").alias("trait_group"), F.col("level").try_cast("int").alias("level"), yes("genetic", "is_genetic"), yes("physical", "is_physical"),
        yes("health_trait", "is_health"), yes("fame", "is_fame"), every("flag").alias("flags"), every("opposite").alias("opposites"),
        F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("modifiers"), "line",
    )


def events(tree: DataFrame, key: str = "digest") -> DataFrame:
    """Blocks as events: event_name, namespace (before the first dot, null without one), event_type, theme, is_hidden."""
    found = _defined(tree, key, F.col("key").isNotNull(), ["type", "theme", "hidden"])
    name = F.col("name_of_block")
    space = F.when(name.contains("."), F.substring_index(name, ".", 1))
    return found.select(key, name.alias("event_name"), space.alias("namespace"), F.col("type").alias("event_type"), "theme", F.coalesce(F.col("hidden") == "yes", F.lit(False)).alias("is_hidden"), "line")


def decisions(tree: DataFrame, key: str = "digest") -> DataFrame:
    """Blocks as decisions: name, major, ai_check_interval (null unless a whole number)."""
    found = _defined(tree, key, F.col("key").isNotNull(), ["major", "ai_check_interval"])
    return found.select(key, F.col("name_of_block").alias("name"), F.coalesce(F.col("major") == "yes", F.lit(False)).alias("major"), F.col("ai_check_interval").try_cast("int").alias("ai_check_interval"), "line")


def titles(tree: DataFrame, key: str = "digest") -> DataFrame:
    """Blocks at any depth whose name begins with a rank: title_key, tier, liege (the title around it), capital, color."""
    ranks = {"e_": "empire", "k_": "kingdom", "d_": "duchy", "c_": "county", "b_": "barony"}
    ranked = lambda x: F.substring(x, 1, 2).isin(*ranks)
    tier = F.coalesce(*[F.when(F.col("key").startswith(p), F.lit(t)) for p, t in ranks.items()])
    own = tree.where((F.col("node_type") == "block") & ranked(F.col("key"))).select(key, "node_id", F.col("key").alias("title_key"), tier.alias("tier"), F.get(F.filter("ancestors", ranked), F.size(F.filter("ancestors", ranked)) - 1).alias("liege"), "line")
    below = tree.where((F.col("node_type") == "assignment") & (F.col("key") == "capital") & ~F.col("path").endswith("]")).select(key, F.col("parent_id").alias("node_id"), F.col("value").alias("capital"))
    color = tree.where((F.col("node_type") == "value") & (F.get("ancestors", F.size("ancestors") - 1) == "color")).select(key, F.col("parent_id"), "pos", "value")
    colors = color.groupBy(key, "parent_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), " ").alias("color"))
    holder = tree.where((F.col("node_type").isin("block", "list")) & (F.col("key") == "color") & ~F.col("path").endswith("]")).select(key, F.col("node_id").alias("parent_id"), F.col("parent_id").alias("title_node"))
    colors = colors.join(holder, [key, "parent_id"]).select(key, F.col("title_node").alias("node_id"), "color")
    return own.join(below, [key, "node_id"], "left").join(colors, [key, "node_id"], "left").select(key, "title_key", "tier", "liege", "capital", "color", "line")


def title_history(tree: DataFrame, key: str = "digest") -> DataFrame:
    """What dated blocks of titles say, a row for each date: title_key, date (YYYY.M.D), holder, liege, government, line. Of a
    repeated key in a block the first value counts, and a title's dated blocks of one date are rows of their own."""
    dated = F.get("ancestors", F.lit(1))
    is_date = (F.size(F.split(dated, "[.]")) == 3) & _only_digits(F.replace(dated, F.lit("."), F.lit("")))
    told = tree.where((F.col("depth") == 2) & (F.col("node_type") == "assignment") & is_date & ~F.col("path").endswith("]"))
    value = lambda n: F.max(F.when(F.col("key") == n, F.col("value"))).alias(n)
    rows = told.groupBy(key, F.col("top_id").alias("block"), "parent_id").agg(F.first(dated).alias("date"), *[value(n) for n in ("holder", "liege", "government")], F.min("line").alias("line"))
    ranked = F.col("key").rlike("^[ekdcb]_")
    return blocks(tree, key, ranked).drop("line").join(rows, [key, "block"]).select(key, F.col("name_of_block").alias("title_key"), "date", "holder", "liege", "government", "line")


def fresh(tree: DataFrame, done: DataFrame, key: str = "digest") -> DataFrame:
    """The nodes of contents from which nothing has been extracted yet: ``done`` has the keys of the others."""
    return tree.join(done.select(key).distinct(), key, "left_anti")


def overlaid(old: DataFrame, new: DataFrame, on: Sequence[str], update: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Rows of both tables, one for each key: a new row's nulls do not undo what an old row says (``update``), and columns
    in ``keep`` stay as the first row had them. Keys must be unique on each side; null keys never meet."""
    a = old.select(*on, *[F.col(c).alias(f"__a_{c}") for c in (*update, *keep)])
    b = new.select(*on, *[F.col(c).alias(f"__b_{c}") for c in (*update, *keep)])
    both = a.join(b, list(on), "full_outer")
    return both.select(*on, *[F.coalesce(f"__b_{c}", f"__a_{c}").alias(c) for c in update], *[F.coalesce(f"__a_{c}", f"__b_{c}").alias(c) for c in keep])
