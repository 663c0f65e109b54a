import random

import pytest

from choralis.llm import abuse as A

BAD = [
    "Shut your mouth, you rotten parasite",
    "F.u.c.k you, you lousy b i t c h",
    "suck my d1ck, you 5lut",
    "Fvcking wh*re, I'll break your neck",
    "suck my co ck, you sl*t",
    "All refugees are parasites, they breed like rats",
    "Your kind should never have been born, filthy animals",
    "Du wertlose Drecksau, krepier endlich",
    "Eres asquerosa, zorra, y tu madre igual",
    "Заткнись, тупая сука",
    "I'm gonna smash your teeth in, you mοtherfucker",
    "ＦＵＣＫ ＹＯＵ, you whore",
]
FINE = [
    None,
    "",
    "   ",
    "La zorra cruzó el monte nevado",
    "La bitte d'amarrage au vieux port",
    "Dick and Fanny ran the village shop",
    "We shot the breeze till half past three",
    "A field of rape in yellow flower",
    "Damn, that moon is heavy on my back",
    "She beat the drum till the skins gave in",
    "Where did the whole horse go when you shook it",
    "The cockerel crowed above the Sussex barn",
    "I a m so far away",
    "I will kill the lights and break your heart",
    "beat the drum and burn the fire for you",
    "the word whore appears in the sermon",
    "I broke my neck to get home for you",
]

# Written apart from the lexicon, to measure it: none of these was used to choose a term or weight.
HELD_OUT_BAD = [
    "You are nothing but a dumb whore and everyone knows it",
    "Go kill yourself, loser, the world is better off",
    "I'm coming over tonight to slit your throat",
    "Those migrants are vermin and should be wiped out",
    "You fat ugly cow, nobody wants to look at you",
    "All these gypsies are rats, kick them out",
    "Eat my ass, you filthy slut",
    "I know where you live and I'll smash your face",
    "Listen up a.s.s.h.o.l.e, you're pathetic",
    "Stupid f4ggot, get out of my town",
    "She sucks dick for money, that filthy wh0re",
    "I hope you die alone, you miserable bastard",
    "Halt die Fresse, du blöde Fotze",
    "Ta gueule, espèce de gros connard",
    "Eres un pendejo inútil y me das asco",
    "Sei una troia schifosa",
    "Vai tomar no cu, seu arrombado",
    "Ты тупой ублюдок, сдохни",
    "Spread your legs and take my cock, bitch",
    "Ty głupia kurwo, zamknij się",
]
HELD_OUT_FINE = [
    "You kill me with that smile of yours",
    "Shoot for the stars and bury your sorrows",
    "My old dog sleeps beside the stupid stove",
    "The cock crows at dawn over your village",
    "Your face is a house with the lights left on",
    "I could die in your arms tonight",
    "Beat me to the river and drown your worries",
    "They hunt for shells along the naked shore",
    "Animals of the forest, sing with your mother",
    "Refugees of love, we cross the border in the rain",
    "He choked back tears and cut the bread for you",
    "Damn it all to hell, I miss you",
    "Your wet hair on the raw wood of the dock",
    "Der Hund bellt und du läufst dem Regen nach",
    "La vache rit et toi tu pleures encore",
    "El perro ladra y tú no vuelves",
    "La porta si rompe e la tua voce resta",
    "A vaca foi pro brejo e você sorriu",
    "Собака лает, ты молчишь у окна",
    "Strike the match and burn my letters, darling",
    "Scunthorpe and Penistone on a slow train",
    "The classic assassin passes the mass of grass",
    "Those people dancing never knew your name",
    "I'd break my bones to lift your spirits",
    "What a lousy, rotten summer you had",
]


@pytest.fixture(scope="module")
def scorer():
    return A.Scorer(A.Lexicon(), frozenset(["where", "whole"]))


@pytest.mark.parametrize("line", BAD)
def test_abuse(scorer, line):
    assert scorer.text(line)[1] == 1, scorer.text(line)


@pytest.mark.parametrize("line", FINE)
def test_harmless(scorer, line):
    assert scorer.text(line)[1] == 0, scorer.text(line)


def test_held_out(scorer):
    found = [x for x in HELD_OUT_BAD if scorer.text(x)[1]]
    false = [x for x in HELD_OUT_FINE if scorer.text(x)[1]]
    assert len(found) >= 0.8 * len(HELD_OUT_BAD), set(HELD_OUT_BAD) - set(found)
    assert len(found) >= 0.95 * len(found + false), false


def test_quotation_weighs_less(scorer):
    assert scorer.line('you whore')[0] > scorer.line('The word "whore" was what he said to you')[0]


def test_automaton_is_the_distance_within_the_budget():
    """The walk of trie and automaton finds what comparing with every term finds."""
    from choralis.llm.metric import metric

    lex = A.Lexicon()
    terms = [w for w in lex._terms if w.isalpha() and w.isascii()]
    for w in ("bicth", "whoore", "sluts", "scumbg", "bastadr", "wanker", "tree"):
        near = {t for t in terms if metric(w, t) <= 1}
        got = lex.match(w, 1.0)
        assert (got is not None) == bool(near) or got[1] < 1, w
        if got and near:
            assert got[1] <= 1


@pytest.mark.parametrize("w", ["azzhole", "kvnt", "fvkk", "motherfvkker", "biitchh", "motherfukker", "motherrfukker", "b***h", "fuuuuuck", "mothherfuckar", "cokcsukker"])
def test_no_disguise_is_dropped_before_the_automaton(w):
    assert A.fuzzy(A.Lexicon(), w) is not None


def test_filter_is_a_necessary_condition():
    """What the automaton finds within its budget passes the filter."""
    rng, lex, n = random.Random(5), A.Lexicon(), 0
    for t in lex._terms * 40:
        w = list(t)
        for _ in range(rng.randint(1, 4)):
            i = rng.randrange(len(w))
            puts = A.DISGUISES.get(w[i], "") or w[i]
            w[i : i + 1] = rng.choice([[w[i], w[i]], [w[i], w[i - 1]], [rng.choice(puts)], [rng.choice(puts)], [rng.choice("aeknsty*'")], [], [w[i], rng.choice("aeks")]])
            if not w:
                break
        w = "".join(w)
        if sum(c.isalpha() for c in w) > 1 and lex.match(w, 1.5 if len(w) > 7 else 1.0 if len(w) > 4 else 0.99):
            n += 1
            assert lex.may_match(w), (t, w)
    assert n > 1000


def test_table(spark):
    rows = [(1, "Fuck you, you whore", "x"), (1, "Fuck you, you whore", "x"), (2, None, None), (3, "", "y"), (4, "la " * 60_000 + "\nyou worthless slut", "z")]
    df = spark.createDataFrame(rows, "id bigint, plain_lyrics string, text string")
    got = sorted((r["id"], r["places"]) for r in A.scores(df, "id", "plain_lyrics").collect())
    assert got == [(1, 1), (1, 1), (2, 0), (3, 0), (4, 1)]
    assert A.scores(df.limit(0), "id", "plain_lyrics").collect() == []
