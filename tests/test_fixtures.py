"""Small texts with known symbols, references, slots and winners."""

from pyspark.sql import functions as F

from palimpsest.functions import rules
from palimpsest.operators import resolve as R
from palimpsest.sources import script

EVENT = """namespace = test_event
@local = 5
test_event.0001 = {
	type = character_event
	trigger = { has_trait = brave NOT = { has_trait = ambitious } }
	immediate = { trigger_event = test_event.0002 has_culture = $CULTURE$ run_scripted_effect = $EFFECT$ add_trait = "" }
	option = { limit = { culture = norse } faith = { x = y } }
}
x = 5
12 = { }
"""
RELIGION = "christian = { faiths = { catholic = { a = 1 } orthodox = { } b = { } } doctrine = d1 }\nempty_religion = { faiths = 3 }"
TITLE = "e_rome = { color = { 1 2 3 } k_italy = { d_latium = { c_roma = { b_roma = { } } } 7 = { c_lost = { } } } }"
ON_ACTIONS = (
    "on_born = { trigger = { is_alive = yes } events = { born.1 born.2 } effect = { gain = 10 } }\non_gone = { trigger = { rules = yes } events = { gone.1 } on_actions = { on_heir } effect = { clear = x } }\non_war = { events = { war.1 war.2 } }",
    "on_born = { trigger = { is_adult = yes } events = { b.1 b.2 b.3 } random_events = { 100 = b.9 50 = b.8 } effect = { gain = 20 } }\non_gone = { events = { b.7 } on_actions = { b_special } }\non_b_only = { events = { b.6 } first_valid = { b.5 } }",
    "on_born = { events = { c.1 } effect = { gain = 30 } }\non_war = { events = { c.2 c.3 } effect = { loss = 1 } }\non_c_only = { trigger = { t = c } events = { c.4 } fallback = { c_next } }",
)
TRADITIONS = ("homes = { cost = 1 adv = 4 }\nwarriors = { cost = 2 }\nsailors = { cost = 3 }", "homes = { cost = 5 adv = 6 }\nnew_one = { cost = 9 }", "homes = { cost = 7 defender_advantage = 8 }\nwarriors = { prowess = 1 }")


def texts(spark, *given):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(given)], "digest string, text string")


def test_symbols(spark):
    files = spark.createDataFrame([("f0", "base", "events/a.txt"), ("f1", "base", "common/religion/religions/r.txt"), ("f2", "base", "common/landed_titles/t.txt")], "digest string, source string, relpath string")
    got = script.symbols(script.nodes(texts(spark, EVENT, RELIGION, TITLE)), files).collect()
    assert sorted((r.name, r.symbol_type, r.line, r.signature) for r in got) == sorted(
        [("test_event.0001", "event", 3, None), ("christian", "religion", 1, None), ("empty_religion", "religion", 2, None), ("catholic", "faith", 1, None), ("orthodox", "faith", 1, None)]
        + [(n, "title", 1, None) for n in ("e_rome", "color", "k_italy", "d_latium", "c_roma", "b_roma")]
    )


def test_references(spark):
    got = script.references(script.nodes(texts(spark, EVENT))).collect()
    assert sorted((r.name, r.ref_type, r.context, r.line) for r in got) == sorted(
        [("brave", "trait", "trigger", 5), ("ambitious", "trait", "trigger", 5), ("test_event.0002", "event", "trigger_event", 6), ("$EFFECT$", "scripted_effect", "run_scripted_effect", 6), ("norse", "culture", "limit", 7)]
    )


def test_merged_slots(spark):
    items = script.slots(script.nodes(texts(spark, *ON_ACTIONS)), (*rules.APPENDED_SLOTS, *rules.SINGLE_SLOTS)).withColumn("load_order", F.substring("digest", 2, 9).cast("int"))
    got = {(r.container, r.slot): (r.merged, r.n_items, r.n_sources, r.winner, r.conflict) for r in R.merge_containers(items, "container", ["load_order", "pos"], "item", "slot", rules.APPENDED_SLOTS).collect()}
    assert got["on_born", "events"] == ("born.1,born.2,b.1,b.2,b.3,c.1", 6, 3, 2, False) and got["on_born", "random_events"] == ("100=b.9,50=b.8", 2, 1, 1, False)
    assert got["on_born", "trigger"] == ("is_adult=yes", 2, 2, 1, True) and got["on_born", "effect"] == ("gain=30", 3, 3, 2, True)
    assert got["on_gone", "on_actions"] == ("on_heir,b_special", 2, 2, 1, False) and got["on_c_only", "fallback"] == ("c_next", 1, 1, 2, False) and len(got) == 15


def test_winning_traditions(spark):
    tree = script.nodes(texts(spark, *TRADITIONS))
    files = spark.createDataFrame([(f"f{i}", i, f"common/culture/traditions/{i}.txt") for i in range(3)], "digest string, source int, relpath string")
    won = R.winners(script.symbols(tree, files), ["name"], ["source", "line", "node_id"]).collect()
    assert {r.name: (r.source, r.overridden_count) for r in won} == {"homes": (2, 2), "warriors": (2, 1), "sailors": (0, 0), "new_one": (1, 0)}
