"""Which altered benchmark passages are found: those within one edit for every 16 bytes."""

from fathom.llm import decontaminate

SHORT = "the quiet harbor holds seven boats and an old crane that lifts no more than stone"
LONG = SHORT + " while gulls over the wet pier wait for bread from children who left at noon today"
EIGHT = "old boat"


def test_passages_with_words_replaced(spark):
    assert (decontaminate.budget(SHORT.encode()), decontaminate.budget(LONG.encode()), decontaminate.budget(b"x" * 15)) == (5, 10, 0)
    texts = {
        "exact": SHORT, "one word of five": SHORT.replace("seven", "built"), "one word of six": SHORT.replace("harbor", "jungle"), "two words in short": SHORT.replace("seven", "built").replace("boats", "vigil"),
        "two words in long": LONG.replace("seven", "built").replace("gulls", "frogs"), "eight": f"an {EIGHT} here", "eight, one letter": "an old goat here",
    }
    docs = spark.createDataFrame([(k, f"Before it, {v} after it.") for k, v in texts.items()], "doc_id string, text string")
    items = spark.createDataFrame([(1, SHORT), (2, LONG), (3, EIGHT)], "item_id long, text string")
    found = {r["doc_id"]: {m["item_id"] for m in r["matches"]} for r in decontaminate.matched(docs, items).collect()}
    caught = {k for k, v in found.items() if v}
    assert caught == {"exact", "one word of five", "two words in long", "eight"}, found
