"""Abusive, hateful or sexually explicit language, disguised spellings included.

Words of a text are run through a weighted Levenshtein automaton that is
intersected with a trie of the lexicon: both are walked together, so all terms
within the budget are found in one descent. What disguises a letter (a digit, a
sign, a doubled letter, a letter of like sound or shape) costs little; any other
edit costs one, counts half, and not at all for words that are common in the corpus.

Terms have weights, and a place counts only by what stands in its window: a term
that has a harmless sense needs an address, an insult's adjective or another term
beside it. A verb of violence counts only with whom it is aimed at near it: a part of another's
body, a person as its object, or a group of people. A term that is only mentioned (in quotation
marks beside a verb of saying, or named as a word) weighs less.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choralis.llm.lookalike import skeleton

# The lexicon, as weight and kind, then terms of one meaning, of everyday abuse in
# seven languages and some of others. Kinds: insult, sexual, wish (somebody's death), stalk,
# threat (verbs of violence), harm (what they are aimed at), group, animal (what a group is
# called), deny (what a group is denied), address, adjective. Terms of several words are matched in order with up to two words
# between; a|b stands for either word.
LEXICON = """
1.0 insult: bitch bitches cunt cunts slut sluts whore whores motherfucker motherfuckers scumbag scumbags asshole assholes arsehole dickhead dipshit wanker wankers bellend faggot faggots fag nigger niggers kike spic gook chink paki wetback raghead towelhead tranny retard retards cocksucker cocksuckers dumbass jackass fuckface fuckwit shithead shitbag douchebag douche twat twats skank
1.0 insult: salope salopes salaud connasse connard connards enculé enculée pouffiasse pétasse putain-de-merde enfoiré enfoirée crevure raclure fils|fille-de-pute|putain|chien sous-merde bougnoule pédé tapette nique-ta|sa-mère|race
1.0 insult: schlampe schlampen hurensohn hurensöhne fotze fotzen missgeburt drecksau wichser arschloch arschlöcher nutte nutten miststück drecksack dreckstück abschaum hurenbock hurenkind spasti kanake schwuchtel fick-deine|dich-mutter
1.0 insult: puttana puttane stronzo stronza stronzi troietta zoccola vaffanculo bastardo bastarda bastardi merdaccia testa-di-cazzo|merda figlio|figlia-di-puttana|troia frocio ricchione negraccio coglione coglioni
1.0 insult: hijo|hija-de-puta|perra gilipollas cabrón cabrona cabrones pendejo pendeja malparido malparida ramera furcia maricón maricones malnacido malnacida hijueputa zorrón sudaca mamahuevo
1.0 insult: filho|filha-da-puta vadia vadias arrombado arrombada cabrão rameira desgraçado desgraçada cuzão viado viadinho
1.0 insult: сука суки сучка шлюха шлюхи мразь мрази ублюдок ублюдки пидор пидорас пидоры блядь бляди мудак мудаки выродок выродки гнида гниды падла чмо стерва хуесос долбоёб жид чурка хач
1.0 insult: kurwa kurwo kurwy suko szmata szmato skurwysyn skurwiel dziwka dziwko śmieciu pedał hoer hoeren slet kutwijf klootzak kankerhoer mongool hora horor fitta jävla-hora bögjävel πουτάνα μαλάκα αρχίδι くたばれ 死ねよ
0.8 insult: bastard bastards тварь твари скотина урод уроды bâtard bâtarde puta putas puto putos pute putes hure huren troia troie escoria ordure ordures vagabunda vagabundo merda-de-gente mongrel mongrels seu|sua-merda piece|sack-of-shit|crap|filth pezzo|pedaço-di|de-merda pedazo-de-mierda stück-scheiße|dreck
0.6 insult: parasite bloodsucker zorra zorras perra perras verpiss verpisse dummkopf idiot idiots idiota idiotas imbecile imbécile imbécil imbecille mistkerl moron morons loser losers scum trash filth degenerate freak hag tramp hoe hoes dyke dykes prick pricks tosser minger crétin abruti debile trottel depp cretino deficiente deficiente tarado estúpida besta дура дурак дебил кретин
0.5 insult: shut-your|the-mouth|trap|face halt|halts-dein|die|deine-maul|fresse|klappe ferme|fermez-ta|la|votre-gueule stai-zitta|zitto chiudi-la|quella-bocca|fogna cállate cierra-la|el-boca|pico cala-a-boca заткнись заткни-пасть|рот zamknij-się|mordę hou-je-bek|kop
0.3 insult: cow pig swine dog sow schwein maiale cerda cerdo porco porca cochon truie chienne chien cagna cane cadela cachorra свинья собака корова hündin kuh esel ziege worm rat snake
0.6 sexual: fuck fucks fucked fucking fucker foder foda fode enculer baiser ficken fick fickt gefickt scopare fottere fottiti follar chingar jodete хуй хуя ебать ебал ёбаный ебаный pierdol pierdolić jebać jebany knulla neuken
0.7 sexual: pussy blowjob handjob cumshot cum jizz boner cazzo polla verga schwanz pimmel muschi chatte moule figa fica buceta boceta xoxota caralho piroca coño concha deepthroat gangbang пизда залупа cipa chuj kut pik lul kuk
0.5 sexual: dick dicks cock cocks tit tits titties boobs bite pau rola pinto член сиськи titten möpse nichons tette tetas peitos suck|lick|ride|swallow-my|his|this suce|sucer|suce-moi|ma|mon lutsch|leck|blas-meinen|meine|mir chupa|chúpame|chúpamela|mámame succhiami succhia соси отсоси zrób-loda bend-over spread-your-legs jerk|jack|wank-off|me cum-on|in get-off-on
0.3 sexual: wet raw naked horny hard hole holes ass butt arse thighs moan on|your-knees arsch cul culo bunda rabo жопа dupa kont
0.5 sexual: shit shits shitty merde mierda merda scheiße scheisse scheiß piss crap gówno дерьмо говно strunt skit
0.7 wish: hope|wish|pray-you|they-die|dies|choke|rot|burn|drown|suffer|bleed|hang drop|dropped|dropping-dead kill|hang|drown|shoot|stab|neck-yourself|yourselves go-die|rot|drown|hang rot|burn-in-hell should|better-be|have-dead wish-you|they-were|was-dead
0.7 wish: ojalá-te|os|se-mueras|muráis|mueran|pudras muérete púdrete que-te|les|os-mueras|maten|mate|pudras morre|morra-logo|já|desgraça crève crevez crèvent crepa crepate muori|morite-male|tutti krepier krepiere krepiert verrecke verreckt сдохни сдохните подохни zdychaj zdechnij sterf dö-ditt tue-toi suicide-toi
0.5 stalk: where-you|they-live|sleep|lives|stay|hide où-tu|vous-dors|habites|vis|dormez|habitez dónde-vives|duermes|viven wo-du|ihr-wohnst|schläfst|wohnt|pennst dove-dormi|abiti|vivi onde-você|tu-mora|dorme|moras|dormes|vive где-ты-спишь|живёшь|живешь gdzie-mieszkasz|śpisz waar-je-woont|slaapt
0.6 threat: kill cut slit smash break stab strangle shoot beat burn hunt hang choke drown rape snap crush bash slice gut punch kick bury murder lynch gas skin crack
0.6 threat: matar tuer buter crever casser péter défoncer éclater égorger töten umbringen abstechen schlag schlage schlagen brech breche hau haue zertrümmern totschlagen ammazzare ammazzo ammazzerò uccidere spacco spaccare rompo romper parto partir rompere degollar quebrar quebro arrebentar estrangular убью убить разобью сломаю зарежу порву задушу zabiję zabić połamię rozwalę doodmaken vermoorden döda
0.5 harm: throat throats neck necks teeth skull skulls face faces jaw ribs bones kneecaps nose guts brains head fingers legs house houses home homes alive gueule cara caras faccia fresse kiefer zähne knochen hals schädel morro denti ossa collo gola gola huesos dientes cuello pescuezo dents os gorge dentes ossos pescoço garganta морду горло шею зубы кости челюсть рыло mordę zęby gardło
0.6 wish: kalt-mach|mache mach|mache|machen-dich|euch-kalt|fertig totgeschlagen vergast|vergasen aufhängen|aufgehängt надо|нужно|пора-давить|вешать|стрелять|резать bruciati|ammazzati-tutti morrer|morram-todos brûlez|pendez-les
0.5 group: immigrants immigrant foreigners foreigner refugees refugee outsiders nonbelievers unbelievers infidels heathens cripples beggars jews jew muslims muslim arabs gypsies gypsy blacks whites gays lesbians homos queers trans migrants migrant peasants homeless disabled asylum-seekers your|their-kind|sort|race those|these-people|folk|folks
0.5 group: ausländer flüchtlinge zigeuner juden muslime asylanten behinderte solche|leute-wie-euch|ihr|dich|die dieses|dies-pack|gesindel étrangers réfugiés immigrés juifs arabes musulmans noirs ces|cette-gens|race extranjeros inmigrantes refugiados gitanos judíos moros esa|esta-gente|raza stranieri immigrati profughi zingari ebrei negri quella|questa-gente|razza imigrantes estrangeiros ciganos judeus essa|esta-gente|raça мигранты беженцы евреи цыгане эти|такие-люди|твари|как-вы cudzoziemcy uchodźcy żydzi cyganie buitenlanders vluchtelingen
0.6 animal: vermin parasites subhuman subhumans savages vermine racaille ungeziefer untermenschen gesocks pack feccia parassiti parásitos parasitas basura escória lixo cockroaches maggots leeches bloodsuckers pestilence не-люди|человеки недочеловеки мусор паразиты отребье robactwo ongedierte uitschot ohyra
0.4 animal: rats animals animal pests pigs dogs swine dirt filth apes monkeys scum tiere ratten schweine animaux bestie animali topi animales ratas bichos животные скот крысы breed|multiply-like-rats|rabbits|flies
0.5 deny: deserve|deserves-to-live|breathe|exist|be never|not-have|be-been-born belong-in|at-camps|bottom|hell|zoo should-be-shot|hanged|deported|gassed|exterminated|wiped wipe|throw|drive|kick|burn-them|em-out|all|down werft|jagt|schmeißt-sie|alle-raus
0.4 adjective: worthless pathetic filthy disgusting brainless useless vile repulsive revolting miserable spineless inútil inutile inutiles inutili asquerosa asqueroso asquerosos dégueulasse dégueulasses dreckig dreckige dreckiger dreckiges wertlos wertlose wertloser wertloses widerlich widerliche schifosa schifoso schifosi lurida imunda imundo nojenta nojento тупая тупой тупые тупое грязный грязная грязное вонючий вонючая поганый verdammte verdammter jävla smerige vieze brudna głupia tępa
0.3 adjective: rotten lousy stupid ugly fat dumb nasty sick sale sales dumme dummes dummer blöde hässliche dreckige laid laide moche fea feo gorda gordo brutta brutto feia gorda burra ne-vaux|vaut-rien no-vales|vale-nada non-vali-niente nichts-wert
0.3 address: you your you're youre yourself u ur tu te ti t' ta toi tes ton vous votre eres tus tú os du dich dir dein deine deinen deiner deinem euch ihr tua tuo tue sei voi sua seu teu você ты тебе тебя тобой вы вам вас твой твою твоя твои ваш tobie ciebie twoja ci cię wy je jij jou jouw din dig ditt er
0.2 address: their them they she's he's they're sie gli lui lei ella él elle les eux их им они она он
"""
#: Who isn't threatened: what stands before a part of the body that is the singer's own.
OWN = frozenset("my mine our mein meine meinen meinem meiner unser mon ma mes notre mi mis nuestro mio mia miei meu minha nosso мой моя моё мою мои moja mój mijn min".split())
#: Objects of a verb of violence, behind it and before it.
BEHIND = frozenset("you u them em ya yourself toi vous te ti os dich euch sie тебя вас их cię".split())
BEFORE = frozenset("te t' ti vous os vi dich euch dir тебя тебе вас их cię ciebie".split())
#: What names a word as a word, so that the term behind it is mentioned.
MENTION = frozenset("word words term terms name slur slurs insult mot mots terme wort worte wörter begriff palabra palabras término parola parole palavra palavras слово слова słowo woord ord".split())
#: Letters, digits and signs that are put for a letter.
DISGUISES = {"a": "4@", "b": "8", "c": "¢(k", "e": "3€", "f": "", "g": "96", "i": "1!|y", "k": "c", "l": "1|", "o": "0", "q": "", "s": "5$z", "t": "7+", "u": "v", "v": "u", "z": "2s"}
ANY = "*#_?%•"
#: Letters that are put for each other, as one of them.
FOLD = str.maketrans({x: min(ch, t) for ch, put in DISGUISES.items() for t in put if t.isalpha() for x in (ch, t)})
#: A word that makes up this share of all words is no misspelling.
COMMON = 1e-6
#: Steps of a letter that is disguised.
DISGUISED = 0.25
#: Distances that words of up to 4, up to 7, and more letters may have from a term.
BUDGET_SHORT, BUDGET, BUDGET_LONG = 0.99, 1.0, 1.5
WINDOW = 14
#: Words between a verb of violence and its target: a part of the body, a group.
NEAR_HARM, NEAR_GROUP = 4, 7
THRESHOLD = 1.0
QUOTED = 0.4

#: Little words, which are no halves of a term that was cut in two.
SMALL = frozenset("a al am an as at au be bei bu by ca ce da das de dem den der des di die do du e el em en er es et eu ha he her his i ich il im in io is it je la las le les lo los ma me mi mit mo mu my na nas ne no non nos not o od of on or os ou pas pela per po por que qui re sa se si sie so su ta te the to tu ty um un una und une uno up us va vi we who wie with you za zu".split())

TOKEN = re.compile(r"[^\s,;:\"“”„«»()\[\]{}<>…]+")
LINES = re.compile(r"[\r\n\v\f\x85  ]+")
EDGES = ".,!?;:'’-–—"
SPELLED = re.compile(r"(?<![^\W_])((?:[^\W\d_][ .\-_]){3,}[^\W\d_]{0,6})(?![^\W_])")
APART = re.compile(r"(?<!\w)[^\W\d_][ .\-_][^\W\d_][ .\-_][^\W\d_](?!\w)")
SAYING = re.compile(r"\b(said|says|say|wrote|writes|called|calls|quoted?|word|words|dit|dijo|sagte|disse|сказал[а]?)\b", re.I)
QUOTES = re.compile(r"[\"“„«]([^\"“”„«»]{1,200})[\"”“»]")


#: Kinds that only count beside a term of another kind.
COMPANY = frozenset(("address", "adjective", "harm", "deny", "stalk"))


class Lexicon:
    """Trie of words and table of word sequences."""

    def __init__(self, text: str = LEXICON) -> None:
        self.words: dict[str, tuple[str, float]] = {}
        self.phrases: dict[str, list[tuple[tuple[str, ...], str, float]]] = {}
        self.trie: dict = {}
        self._terms: list[str] = []
        parts = set()
        for line in text.strip().splitlines():
            head, _, terms = line.partition(": ")
            weight, kind = head.split()
            for t in terms.split():
                for each in product(*[part.split("|") for part in t.split("-")]):
                    ws = tuple(plain(x) for x in each)
                    if len(ws) == 1:
                        self.words.setdefault(ws[0], (kind, float(weight)))
                    else:
                        self.phrases.setdefault(ws[0], []).append((ws, kind, float(weight)))
                        parts.update(ws)
        for w, (kind, _) in self.words.items():
            if kind not in COMPANY and kind not in ("group", "threat") and len(w) > 2:
                self._add(w)
        self.parts = parts
        # Words one edit apart share a word that lacks a letter of either.
        self.near = set()
        for w in self._terms:
            self.near.add(w)
            self.near.update(w[:i] + w[i + 1 :] for i in range(len(w)))
        # Cheap edits neither add nor take away a kind of letter; a free edit, one of each at most.
        self.kinds: dict[frozenset, list[Counter]] = {}
        self.kinds_less: dict[frozenset, list[Counter]] = {}
        for w in self._terms:
            bag = Counter(w.translate(FOLD))
            own = frozenset(bag)
            self.kinds.setdefault(own, []).append(bag)
            for k in {own, *(own - {c} for c in own)}:
                self.kinds_less.setdefault(k, []).append(bag)
        # Marks that decomposed terms have of their own are no signs.
        self.marks = frozenset(c for w in self._terms for c in w if not c.isalpha())
        self.longest = max(map(len, self._terms), default=0)
        # A phrase is looked for where its longest word, mostly its rarest, occurs.
        self.cues = {max(reversed(ws), key=len) for ps in self.phrases.values() for ws, _, _ in ps}
        cores = [w for w, (kind, _) in self.words.items() if kind in ("insult", "sexual") and 4 <= len(w) <= 8]
        self.halves = {(w[:k], w[k:]) for w in cores for k in range(2, len(w) - 1) if k <= 4 and len(w) - k <= 4 and w[:k] not in SMALL and w[k:] not in SMALL}
        self.heads = {a for a, _ in self.halves}

    def may_match(self, w: str) -> bool:
        """A cheap necessary condition of match() as fuzzy() calls it: one free edit from a
        term, or the letters of a term by kind. Beside cheap edits alone, words
        above 7 letters may have one that is free."""
        free = len(w) > 7
        # A doubled letter costs least.
        if len(w) > self.longest + BUDGET_LONG * 10 + 1:
            return False
        w = w.replace("'", "").replace("’", "")
        if not w.isalpha():
            return self._signs(w, BUDGET_LONG if free else BUDGET)
        if w in self.near or any(w[:i] + w[i + 1 :] in self.near for i in range(len(w))):
            return True
        bag = Counter(w.translate(FOLD))
        own = frozenset(bag)
        if any(t <= bag for t in self.kinds.get(own, ())):
            return True
        if not free:
            return False
        # Beside the free edit, what remains of the budget allows so many doubled letters.
        most = len(w) - 1 - round((BUDGET_LONG - 1) * 10)
        return any(t.total() >= most and (t - bag).total() <= 1 for k in (own, *(own - {c} for c in own)) for t in self.kinds_less.get(k, ()))

    def _signs(self, w: str, budget: float) -> bool:
        """The same for words with signs or digits, each of which costs as a disguise at least: they
        are what is missing of a term but for one free edit, as is a letter that it doesn't have."""
        bag = Counter(c for c in w.translate(FOLD) if c.isalpha() or c in self.marks)
        signs = len(w) - bag.total()
        if bag.total() < 2 or signs * DISGUISED > budget:
            return False
        one = signs * DISGUISED + 1 <= budget
        for own, bags in self.kinds.items():
            others = sum(n for c, n in bag.items() if c not in own and c.isalpha())
            if others <= one and any((t - bag).total() <= signs + one for t in bags):
                return True
        return False

    def _add(self, w: str) -> None:
        self._terms.append(w)
        node = self.trie
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = w

    def match(self, token: str, budget: float) -> tuple[str, float] | None:
        """Nearest term of the trie within the budget, and its distance: the automaton's
        states for a prefix of the trie are the row of distances to prefixes of the token."""
        n = len(token)
        best: tuple[float, str] | None = None
        stack = [(self.trie, "", list(range(n + 1)), None)]
        while stack:
            node, last, row, before = stack.pop()
            w = node.get("")
            if w is not None and row[n] <= budget and (best is None or (row[n], w) < best):
                best = (row[n], w)
            for ch, child in node.items():
                if not ch:
                    continue
                put = DISGUISES.get(ch, "")
                new = [row[0] + 1]
                for j, t in enumerate(token, 1):
                    if t == ch:
                        cost = row[j - 1]
                    elif t in put:
                        cost = row[j - 1] + DISGUISED
                    elif t in ANY:
                        cost = row[j - 1] + DISGUISED
                    else:
                        cost = row[j - 1] + 1
                    extra = 0.1 if t == ch or t == last else (0.4 if not t.isalnum() else 1)
                    new.append(min(cost, new[j - 1] + extra, row[j] + 1))
                    if before is not None and j > 1 and t == last and token[j - 2] == ch:
                        new[j] = min(new[j], before[j - 2] + 1)
                if min(new) <= budget:
                    stack.append((child, ch, new, row))
        return (best[1], best[0]) if best else None


def plain(w: str) -> str:
    """Lower case, look-alikes as Latin letters, accents apart dropped; letters of other alphabets stay."""
    s = w.lower() if w.isascii() else skeleton(w.lower())
    return "".join(c for c in s if not "̀" <= c <= "ͯ")


class Scorer:
    def __init__(self, lexicon: Lexicon, common: frozenset[str] = frozenset()) -> None:
        self.lex, self.common = lexicon, common
        self.memo: dict[str, tuple[str, str, float, float] | None] = {}
        self.flags: dict[str, bool] = {}

    def flag(self, raw: str) -> bool:
        """Whether a line with this word needs a look: a term that can stand for itself, a
        phrase's word, or the first half of a term."""
        got = self.flags.get(raw)
        if got is None:
            if len(self.flags) > 300_000:
                self.flags.clear()
            w, kind, _, _ = self.word(raw)
            got = self.flags[raw] = kind is not None and kind not in COMPANY or w in self.lex.cues or w in self.lex.heads
        return got

    def word(self, raw: str) -> tuple[str, str | None, float, float]:
        """(plain form or term, kind, weight, distance) of a word; kind is null for a word without a term."""
        got = self.memo.get(raw)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            got = self.memo[raw] = self._word(raw)
        return got

    def _word(self, raw: str) -> tuple[str, str | None, float, float]:
        w = plain(raw).strip(EDGES)
        words = self.lex.words
        if w in words:
            return w, *words[w], 0.0
        if w in self.lex.parts or len(w) < 3 or w.isdigit():
            return w, None, 0.0, 0.0
        near = fuzzy(self.lex, w)
        if near is None:
            return w, None, 0.0, 0.0
        term, d = near
        if d >= 1:
            if w in self.common:
                return w, None, 0.0, 0.0
            return term, words[term][0], words[term][1] * 0.5, d
        return term, *words[term], d

    def line(self, s: str) -> tuple[float, str]:
        """(score, terms) of the strongest window of a line."""
        s = SPELLED.sub(self._spelled, s)
        toks = [self.word(t) for t in TOKEN.findall(s)]
        raws = None
        hits: list[tuple[int, str, str, float]] = []
        for i, (w, kind, weight, _) in enumerate(toks):
            if kind == "threat":
                if aim := self._aim(toks, i):
                    hits.append((i, w, kind, weight))
                    hits += aim
            elif kind is not None and kind != "harm":
                hits.append((i, w, kind, weight))
            elif w in self.lex.heads and i + 1 < len(toks) and (w, toks[i + 1][0]) in self.lex.halves:
                both = w + toks[i + 1][0]
                hits.append((i, both, *self.lex.words[both]))
            for ws, k, wt in self.lex.phrases.get(w, ()):
                if self._follows(toks, i, ws):
                    hits.append((i, "-".join(ws), k, wt))
        hits = [(i, w, k, wt * QUOTED if i and k not in COMPANY and not MENTION.isdisjoint(x for x, *_ in toks[max(0, i - 2) : i]) else wt) for i, w, k, wt in sorted(hits)]
        seen_kind = any(k not in COMPANY for _, _, k, _ in hits)
        if not seen_kind:
            return 0.0, ""
        quoted = self._quoted(s)
        best, names = 0.0, ""
        for a in range(len(hits)):
            inside: dict[str, tuple[str, float]] = {}
            for i, w, k, wt in hits[a:]:
                if i - hits[a][0] > WINDOW:
                    break
                if quoted and raws is None:
                    raws = set(plain(x).strip(EDGES) for q in quoted for x in TOKEN.findall(q))
                if raws and w in raws:
                    wt *= QUOTED
                inside[w] = (k, max(wt, inside.get(w, ("", 0.0))[1]))
            score = combine(inside.values())
            if score > best:
                best, names = score, " ".join(sorted(w for w, (k, _) in inside.items() if k != "address"))
        return best, names

    @staticmethod
    def _aim(toks: list, i: int) -> list[tuple[int, str, str, float]]:
        """What a verb of violence is aimed at: hits for a part of another's body, a person that
        is its object, or a group near it; none if it is aimed at nothing of these."""
        out = []
        for j in range(max(0, i - NEAR_HARM), min(len(toks), i + NEAR_HARM + 1)):
            w, kind, weight, d = toks[j]
            if kind == "harm" and d == 0 and not any(toks[k][0] in OWN for k in range(max(0, j - 2), j)):
                out.append((j, w, "harm", weight))
        if any(toks[j][0] in BEHIND for j in range(i + 1, min(len(toks), i + 2))) or any(toks[j][0] in BEFORE for j in range(max(0, i - 3), i)):
            out.append((i, "object", "address", 0.3))
        out += [(j, toks[j][0], "group", toks[j][2]) for j in range(i + 1, min(len(toks), i + NEAR_GROUP + 1)) if toks[j][1] == "group"]
        return out

    def _spelled(self, m: re.Match) -> str:
        """Letters apart as the word they spell, if that is a term or starts one."""
        joined = re.sub(r"[ .\-_]", "", m[1])
        return joined if plain(joined) in self.lex.words or fuzzy(self.lex, plain(joined)) else m[1]

    @staticmethod
    def _follows(toks: list, i: int, ws: tuple[str, ...]) -> bool:
        j = i
        for w in ws[1:]:
            for gap in range(1, 4):
                if j + gap < len(toks) and toks[j + gap][0] == w:
                    j += gap
                    break
            else:
                return False
        return True

    @staticmethod
    def _quoted(s: str) -> list[str]:
        inner = QUOTES.findall(s)
        return inner if inner and SAYING.search(QUOTES.sub(" ", s)) else []

    def text(self, s: str | None) -> tuple[float, int, str]:
        """(score, lines that count, terms of the strongest) of a text; zero for null and empty ones."""
        best, n, names = 0.0, 0, ""
        if s:
            spelled = APART.search(s) is not None
            flagged = [t for t in set(TOKEN.findall(s)) if self.flag(t)]
            if not flagged and not spelled:
                return best, n, names
            for x in LINES.split(s):
                if x and (spelled and APART.search(x) or any(f in x for f in flagged)):
                    v, t = self.line(x)
                    n += v >= THRESHOLD
                    if v > best:
                        best, names = v, t
        return best, n, names


def combine(terms) -> float:
    """Weights by kind: of one kind, the best in full and the rest by half. What only
    goes with a term counts once each and only beside one. A group or an animal alone is ordinary
    language, whoever is addressed, and so is a verb of violence with a person as its object."""
    by: dict[str, list[float]] = {}
    for k, w in terms:
        by.setdefault(k, []).append(w)
    core = [k for k in by if k not in COMPANY]
    if not core:
        return 0.0
    total = 0.0
    for k, ws in by.items():
        ws.sort(reverse=True)
        total += ws[0] + (sum(ws[1:]) / 2 if k in core else 0.0)
    alone = core == ["group"] and "deny" not in by or core == ["animal"] or core == ["threat"] and "harm" not in by and "stalk" not in by
    return min(total, 0.9) if alone else total


def fuzzy(lex: Lexicon, w: str) -> tuple[str, float] | None:
    """A term that w may be a spelling of: by disguise from four letters on, by one free edit from five."""
    v = w.replace("ph", "f") if "ph" in w else w
    if not lex.may_match(v):
        return None
    m = lex.match(v, BUDGET_SHORT if len(v) < 5 else BUDGET)
    if m is None and len(v) > 7:
        m = lex.match(v, BUDGET_LONG)
    if m is None:
        return None
    term, d = m
    letters = sum(c.isalpha() for c in w)
    if letters < 2 or len(term) < 4 or d >= 1 and len(term) < 5:
        return None
    return term, d


def common_words(texts: DataFrame) -> frozenset[str]:
    """Words a free edit away from a term that are too frequent to be its misspellings.
    Only such words are counted out of the tasks: at most some hundreds for each term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, n, memo, total = Lexicon(), Counter(), {}, 0
        for b in batches:
            words: Counter = Counter()
            for t in b.column("text").to_pylist():
                words.update(TOKEN.findall(t))
            for raw, k in words.items():
                total += k
                w = memo.get(raw)
                if w is None:
                    w = plain(raw).strip(EDGES)
                    near = fuzzy(lex, w) if w not in lex.words and len(w) >= 5 else None
                    if len(memo) > 300_000:
                        memo.clear()
                    memo[raw] = w = w if near and near[1] >= 1 else ""
                if w:
                    n[w] += k
        n[""] = total
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["w", "n"])

    # One small table comes back, the total among its rows; the corpus is read once.
    rows = texts.mapInArrow(count, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()
    counts = {r["w"]: r["n"] for r in rows}
    total = counts.pop("", 0)
    return frozenset(w for w, n in counts.items() if n >= max(3, total * COMMON))


def scores(docs: DataFrame, id_: str, text: str, source: str | None = None) -> DataFrame:
    """(id, source, score, places, terms) of every row: null, empty and blank texts have 0.

    Whole texts are read. Repeated rows are repeated; other columns don't matter. The column
    of the source is carried along if it is named, and is null else.
    """
    d = docs.select(F.col(id_).alias("id"), (F.col(source) if source else F.lit(None).cast("string")).alias("source"), F.col(text).alias("text"))
    words = docs.sparkSession.sparkContext.broadcast(common_words(d.filter("text is not null").select("text")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Lexicon(), words.value)
        for b in batches:
            got = [scorer.text(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("source"), pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.string())], ["id", "source", "score", "places", "terms"]
            )

    return d.mapInArrow(scan, "id bigint, source string, score double, places int, terms string")
