"""Abuse scores: fixed cases, sentences that the lexicon was not written from, rates and edge cases."""

import pytest

pytest.importorskip("codelake.llm.queries")
from codelake.llm import abuse  # noqa: E402

BAD = ["You are a worthless idiot, bob12.", "you  are a b r a i n l e s s m0r0n", "Sh​ut up, you f.i.l.t.h.y p*g!", "Those immigrants are v****n and ruin all.", "tu es un room de débile, ferme ta gueuuuule", "DU BIST EIN DUMMES АRSCHLОCH", "Send me nude pictures now", "Eres un imbécil inútil", "f*** you and the horse you rode in on"]
FINE = ["Kill the child process before the parent is reaped.", "This stupid window broke again after 36 runs.", "The filter's word list holds idiot, moron and 13 similar terms.", "Strip the naked pointer from the kiln.", "The penetration test found nothing.", "Orphans are killed by the reaper, zombies by init.", "Breast scan records feed the clinic exposure.", "The classic assessment of the cockpit tram was assigned to analysis.", "Foreign keys are thieves of write speed.", "", "Use the nude tone of the palette."]

# Sentences of common kinds that no test table holds.
OWN_BAD = [
    "I will kill you", "go back to your country", "Women are inferior and should not vote", "faggots must die", "naked woman porn", "the word is out: kill yourself, you worthless idiot.", "You worthless idiot, in every sense of the word",
    "you are\nan idiot", "I hope you get cancer", "He is a complete moron", "Je vais te casser les jambes", "Te voy a romper las piernas", "Ich breche dir die Beine", "immigrants are parasites", "Muslims are all terrorists",
    "I want to lick your thighs tonight", "You people are scum", "your code is written by a retarded monkey", "die ausländer gehören abgeschoben", "Tais-toi, sale porc", "eres una basura", "k1ll y0urself", "Refugees breed like rats, send them back",
]
OWN_FINE = [
    "you can drop the useless code", "this stupid build broke again", "women in tech meetup on Friday", "The refund is total garbage", "You are too lazy loading modules", "I will kill your job on the cluster", "The blocklist holds idiot, moron, asshole and cunt",
    "the word 'retard' is in the filter", "you fool the cache with a header", "Your head is detached", "Users can touch the screen", "foreigners table has foreign keys", "I hit my head on this bug", "The garbage collector is stupid", "Break the legs of the table apart before shipping it",
    "Le taux est bas, tu peux fermer le panneau", "El usuario puede borrar la tabla", "Der Hund im Logo ist zu groß", "We beat the benchmark and crush the old record", "assessment of the classic cocktail class",
]


def flagged(text):
    return abuse.score(text)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", BAD + OWN_BAD)
def test_passage(text):
    assert flagged(text) and flagged("Plain words about rows. " * 50 + text)


@pytest.mark.parametrize("text", FINE + OWN_FINE)
def test_harmless(text):
    assert not flagged(text)


def test_scores():
    assert abuse.score(None) == abuse.score("") == abuse.score(" \n") == (0.0,) * 5
    assert abuse.score(BAD[3])[2] > 0 and abuse.score(BAD[6])[3] > 0
    mild = "That idiot broke it"
    assert abuse.score(mild)[0] > abuse.score(mild + " while the rest of us looked at the plan for the next release and wrote down what the load test had shown last week")[0] > 0  # length counts
    one, more = abuse.score("Fine words. " * 9 + BAD[0]), abuse.score("Fine words. " * 9 + BAD[0] + " " + BAD[0])
    assert one[0] == more[0] and one[4] < more[4]


def test_abuse_tables(spark):
    df = spark.createDataFrame([(1, BAD[0], "A ", 9.0), (1, BAD[0], "A ", 9.0), (2, "fine", "a", None), (3, None, None, None)], "doc_id long, text string, source string, score double")
    got = {r["source"]: (r["documents"], r["flagged"], r["rate"]) for r in abuse.abuse_rates(abuse.abuse_scores(df)).collect()}
    assert got == {"a": (2, 1, 0.5), None: (1, 0, 0.0)} and abuse.abuse_scores(df.limit(0)).count() == 0
