"""Suffix-stripping stemmers by the published Snowball rules, and short stop-word lists.

Each stemmer takes a word in lower case. Regions: R1 is what follows the first consonant after a vowel, R2 the
same within R1, RV (Romance languages) what follows the stressed vowel. A language without rules of its own
here leaves words as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _longest(word: str, ends: Sequence[str]) -> str | None:
    return next((e for e in sorted(ends, key=len, reverse=True) if word.endswith(e)), None)


# --- English -------------------------------------------------------------------------------------------------

# Words with stems of their own, and words that the first steps leave alone.
_EN_WHOLE = dict(x.split(":") for x in "dying:die lying:lie tying:tie skis:ski skies:sky idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl sky:sky news:news howe:howe atlas:atlas cosmos:cosmos bias:bias andes:andes".split())
_EN_DONE = "inning outing canning herring earring proceed exceed succeed".split()
# Endings in R1 and what takes their place.
_EN_2 = dict(x.split(":") for x in "tional:tion enci:ence anci:ance abli:able entli:ent izer:ize ization:ize ational:ate ation:ate ator:ate alism:al aliti:al alli:al fulness:ful ousli:ous ousness:ous iveness:ive iviti:ive biliti:ble bli:ble fulli:ful lessli:less".split())
_EN_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_EN_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word.replace("’", "'").lstrip("'")
    if w in _EN_WHOLE:
        return _EN_WHOLE[w]
    # a y that is no vowel is marked
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in "aeiouy" and w[i - 1 : i] != "") else c for i, c in enumerate(w))
    vowels = "aeiouy"
    head = next((p for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = len(head) if head else _region(w, vowels)
    r2 = _region(w, vowels, r1)

    def short(s: str) -> bool:
        if len(s) == 2:
            return s[0] in vowels and s[1] not in vowels
        return len(s) > 2 and s[-3] not in vowels and s[-2] in vowels and s[-1] not in vowels + "wxY"

    for e in ("'s'", "'s", "'"):
        if w.endswith(e):
            w = w[: -len(e)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in vowels for c in w[:-2]):
        w = w[:-1]
    if w in _EN_DONE:
        return w
    e = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if e in ("eed", "eedly"):
        if len(w) - len(e) >= r1:
            w = w[: -len(e)] + "ee"
    elif e and any(c in vowels for c in w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
            w = w[:-1]
        elif short(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in vowels:
        w = w[:-1] + "i"
    e = _longest(w, [*_EN_2, "ogi", "li"])
    if e and len(w) - len(e) >= r1:
        if e == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif e == "li":
            w = w[:-2] if w[-3:-2] in tuple("cdeghkmnrt") else w
        else:
            w = w[: -len(e)] + _EN_2[e]
    e = _longest(w, [*_EN_3, "ative"])
    if e and len(w) - len(e) >= r1:
        if e != "ative":
            w = w[: -len(e)] + _EN_3[e]
        elif len(w) - 5 >= r2:
            w = w[:-5]
    e = _longest(w, [*_EN_4, "ion"])
    if e and len(w) - len(e) >= r2 and (e != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not short(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# --- German and the Scandinavian languages -----------------------------------------------------------------


def german(word: str) -> str:
    vowels = "aeiouyäöü"
    w = word.replace("ß", "ss")
    w = "".join(c.upper() if c in "uy" and 0 < i < len(w) - 1 and w[i - 1] in vowels and w[i + 1] in vowels else c for i, c in enumerate(w))
    r1 = _region(w, vowels)
    r2 = _region(w, vowels, r1)
    r1 = max(3, r1)
    e = _longest(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if e and len(w) - len(e) >= r1 and (e != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(e)]
        if e in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    e = _longest(w, ("en", "er", "est", "st"))
    if e and len(w) - len(e) >= r1 and (e != "st" or w[-3:-2] in tuple("bdfghklmnt") and len(w) >= 6):
        w = w[: -len(e)]
    e = _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if e and len(w) - len(e) >= r2:
        stem = w[: -len(e)]
        if e in ("end", "ung"):
            w = stem
            if w.endswith("ig") and not w.endswith("eig") and len(w) - 2 >= r2:
                w = w[:-2]
        elif e in ("ig", "ik", "isch"):
            w = w if stem.endswith("e") else stem
        elif e in ("lich", "heit"):
            w = stem
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = stem
            x = _longest(w, ("lich", "ig"))
            if x and len(w) - len(x) >= r2:
                w = w[: -len(x)]
    return w.lower().translate(str.maketrans("äöü", "aou"))


def _nordic(word: str, vowels: str, endings: Sequence[str], before_s: str, pairs: Sequence[str], last: Callable[[str, int], str], more: Callable[[str, int], str] = lambda w, r1: w) -> str:
    r1 = max(3, _region(word, vowels))
    w = word
    e = _longest(w[r1:], endings) if len(w) > r1 else None
    if e and len(w) - len(e) >= r1:
        w = w[: -len(e)]
    elif len(w) > r1 and w.endswith("s") and w[-2:-1] and w[-2] in before_s:
        w = w[:-1]
    w = more(w, r1)
    if any(w[r1:].endswith(p) for p in pairs):
        w = w[:-1]
    return last(w, r1)


# Endings of nouns, adjectives and verbs.
_SV = "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split()
_NO = "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split()
_DA = "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret".split()


def swedish(word: str) -> str:
    def last(w: str, r1: int) -> str:
        e = _longest(w[r1:], ("lig", "els", "fullt", "löst", "ig"))
        return w if not e else w[:-1] if e in ("fullt", "löst") else w[: -len(e)]

    return _nordic(word, "aeiouyäåö", _SV, "bcdfghjklmnoprtvy", ("dd", "gd", "nn", "dt", "gt", "kt", "tt"), last)


def norwegian(word: str) -> str:
    def last(w: str, r1: int) -> str:
        e = _longest(w[r1:], ("leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov"))
        return w[: -len(e)] if e else w

    if word.endswith(("erte", "ert")) and len(word) - len("erte" if word.endswith("erte") else "ert") >= max(3, _region(word, "aeiouyæåø")):
        return _nordic(word[: word.rindex("er") + 2], "aeiouyæåø", (), "", ("dt", "vt"), last)
    return _nordic(word, "aeiouyæåø", _NO, "bcdfghjlmnoprtvyz", ("dt", "vt"), last)


def danish(word: str) -> str:
    pairs = ("gd", "dt", "gt", "kt")

    def last(w: str, r1: int) -> str:
        if w.endswith("igst"):
            w = w[:-2]
        e = _longest(w[r1:], ("ig", "lig", "elig", "els", "løst"))
        if e == "løst":
            w = w[:-1]
        elif e:
            w = w[: -len(e)]
            if any(w[r1:].endswith(p) for p in pairs):
                w = w[:-1]
        if len(w) > r1 and w[-1] == w[-2] and w[-1] not in "aeiouyæåø":
            w = w[:-1]
        return w

    return _nordic(word, "aeiouyæåø", _DA, "abcdfghjklmnoprtvyzå", pairs, last)


# --- Romance languages ---------------------------------------------------------------------------------------


def _rv(w: str, vowels: str) -> int:
    """RV of Spanish, Italian and Portuguese."""
    if len(w) < 3:
        return len(w)
    if w[1] not in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] in vowels), len(w))
    if w[0] in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in vowels), len(w))
    return 3


# Verb endings that go within RV, and those that go after a vowel-less stem too.
_FR_I = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
_FR_V = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
_FR_PLAIN = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
_FR_ATE = "atrice ateur ation atrices ateurs ations".split()


def french(word: str) -> str:
    vowels = "aeiouyâàëéêèïîôûù"
    w = list(word)
    for i, c in enumerate(w):
        left, right = (w[i - 1] if i else ""), (w[i + 1] if i + 1 < len(w) else "")
        if c in "ui" and left and left in vowels and right and right in vowels or c == "y" and (left and left in vowels or right and right in vowels) or c == "u" and left == "q":
            w[i] = c.upper()
    w = "".join(w)
    if len(w) > 1 and w[0] in vowels and w[1] in vowels or w.startswith(("par", "col", "tap")):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in vowels), len(w))
    r1 = _region(w, vowels)
    r2 = _region(w, vowels, r1)
    has = lambda e, r: w.endswith(e) and len(w) - len(e) >= r
    start, verbs = w, False

    def drop(e: str, to: str = "") -> str:
        return w[: -len(e)] + to

    e = _longest(w, [*_FR_PLAIN, *_FR_ATE, "logie", "logies", "usion", "ution", "usions", "utions", "ence", "ences", "ement", "ements", "ité", "ités", "if", "ive", "ifs", "ives", "eaux", "aux", "euse", "euses", "issement", "issements", "amment", "emment", "ment", "ments"])
    if e in _FR_PLAIN and has(e, r2):
        w = drop(e)
    elif e in _FR_ATE and has(e, r2):
        w = drop(e)
        if w.endswith("ic"):
            w = drop("ic") if has("ic", r2) else drop("ic", "iqU")
    elif e in ("logie", "logies") and has(e, r2):
        w = drop(e, "log")
    elif e in ("usion", "ution", "usions", "utions") and has(e, r2):
        w = drop(e, "u")
    elif e in ("ence", "ences") and has(e, r2):
        w = drop(e, "ent")
    elif e in ("ement", "ements") and has(e, rv):
        w = drop(e)
        if has("iv", r2):
            w = drop("iv")
            if has("at", r2):
                w = drop("at")
        elif w.endswith("eus"):
            w = drop("eus") if has("eus", r2) else drop("eus", "eux") if has("eus", r1) else w
        elif w.endswith(("abl", "iqU")):
            w = w[:-3] if len(w) - 3 >= r2 else w
        elif w.endswith(("ièr", "Ièr")) and len(w) - 3 >= rv:
            w = w[:-3] + "i"
    elif e in ("ité", "ités") and has(e, r2):
        w = drop(e)
        if w.endswith("abil"):
            w = drop("abil") if has("abil", r2) else drop("abil", "abl")
        elif w.endswith("ic"):
            w = drop("ic") if has("ic", r2) else drop("ic", "iqU")
        elif has("iv", r2):
            w = drop("iv")
    elif e in ("if", "ive", "ifs", "ives") and has(e, r2):
        w = drop(e)
        if has("at", r2):
            w = drop("at")
            if w.endswith("ic"):
                w = drop("ic") if has("ic", r2) else drop("ic", "iqU")
    elif e == "eaux":
        w = drop("eaux", "eau")
    elif e == "aux" and has(e, r1):
        w = drop("aux", "al")
    elif e in ("euse", "euses"):
        w = drop(e) if has(e, r2) else drop(e, "eux") if has(e, r1) else w
    elif e in ("issement", "issements") and has(e, r1) and w[: -len(e)][-1:] not in tuple(vowels):
        w = drop(e)
    elif e == "amment" and has(e, rv):
        w, verbs = drop(e, "ant"), True
    elif e == "emment" and has(e, rv):
        w, verbs = drop(e, "ent"), True
    elif e in ("ment", "ments") and len(w) - len(e) - 1 >= rv and w[: -len(e)][-1:] in tuple(vowels):
        w, verbs = drop(e), True
    changed = w != start
    if not changed or verbs:
        before = w
        e = _longest(w[rv:], _FR_I)
        if e and len(w) - len(e) - 1 >= rv and w[: -len(e)][-1] not in vowels:
            w = drop(e)
        if w == before:
            e = _longest(w[rv:], [*_FR_V, *_FR_A, "ions"])
            if e == "ions":
                w = drop(e) if has(e, r2) else w
            elif e in _FR_V:
                w = drop(e)
            elif e:
                w = drop(e)
                if has("e", rv):
                    w = drop("e")
        changed = changed or w != before
        changed = w != before or (changed and not verbs)
    if changed:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if w.endswith("s") and w[-2:-1] not in tuple("aiouès"):
            w = w[:-1]
        e = _longest(w[rv:], ("ion", "ier", "ière", "Ier", "Ière", "e", "ë"))
        if e == "ion":
            if has(e, r2) and w[-4:-3] in ("s", "t") and len(w) - 4 >= rv:
                w = drop(e)
        elif e in ("ier", "ière", "Ier", "Ière"):
            w = drop(e, "i")
        elif e == "e":
            w = drop(e)
        elif e == "ë" and w[-3:-1] == "gu":
            w = drop(e)
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    k = len(w)
    while k and w[k - 1] not in vowels:
        k -= 1
    if k < len(w) and k and w[k - 1] in "éè":
        w = w[: k - 1] + "e" + w[k:]
    return w.lower()


# Pronouns after verbs, and endings of nouns, adjectives and verbs.
_ES_PRO = "me se sela selo selas selos la le lo las les los nos".split()
_ES_1 = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
_ES_ADOR = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
_ES_Y = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_ES_EN = "en es éis emos".split()
_ES_V = "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos".split()


def spanish(word: str) -> str:
    vowels, w = "aeiouáéíóúü", word
    rv = _rv(w, vowels)
    r1 = _region(w, vowels)
    r2 = _region(w, vowels, r1)
    plain = str.maketrans("áéíóú", "aeiou")
    e = _longest(w[rv:], _ES_PRO)
    if e:
        stem = w[: -len(e)]
        x = _longest(stem[rv:], ("iéndo", "ándo", "ár", "ér", "ír", "ando", "iendo", "ar", "er", "ir", "yendo"))
        if x in ("iéndo", "ándo", "ár", "ér", "ír"):
            w = stem[: -len(x)] + x.translate(plain)
        elif x and (x != "yendo" or stem[-6:-5] == "u"):
            w = stem
    start = w
    e = _longest(w, [*_ES_1, *_ES_ADOR, "logía", "logías", "ución", "uciones", "encia", "encias", "amente", "mente", "idad", "idades", "iva", "ivo", "ivas", "ivos"])
    at = len(w) - len(e) if e else 0
    if e == "amente" and at >= r1:
        w = w[:at]
        x = _longest(w, ("iv", "os", "ic", "ad"))
        if x and len(w) - 2 >= r2:
            w = w[:-2]
            if x == "iv" and w.endswith("at") and len(w) - 2 >= r2:
                w = w[:-2]
    elif e and e != "amente" and at >= r2:
        w = w[:at]
        if e in _ES_ADOR and w.endswith("ic") and len(w) - 2 >= r2:
            w = w[:-2]
        elif e.startswith("log"):
            w += "log"
        elif e.startswith("uc"):
            w += "u"
        elif e.startswith("enc"):
            w += "ente"
        elif e == "mente":
            x = _longest(w, ("ante", "able", "ible"))
            w = w[: -len(x)] if x and len(w) - len(x) >= r2 else w
        elif e.startswith("idad"):
            x = _longest(w, ("abil", "ic", "iv"))
            w = w[: -len(x)] if x and len(w) - len(x) >= r2 else w
        elif e[:2] == "iv" and w.endswith("at") and len(w) - 2 >= r2:
            w = w[:-2]
    if w == start:
        e = _longest(w[rv:], _ES_Y)
        if e and w[: -len(e)].endswith("u"):
            w = w[: -len(e)]
        else:
            e = _longest(w[rv:], [*_ES_EN, *_ES_V])
            if e:
                w = w[: -len(e)]
                if e in _ES_EN and w.endswith("gu"):
                    w = w[:-1]
    e = _longest(w[rv:], ("os", "a", "o", "á", "í", "ó", "e", "é"))
    if e:
        w = w[: -len(e)]
        if e in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(plain)


# --- Dutch and Russian ---------------------------------------------------------------------------------------


def dutch(word: str) -> str:
    w = word.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    vowels = "aeiouyè"
    w = "".join(c.upper() if c == "y" and (i == 0 or w[i - 1] in vowels) or c == "i" and 0 < i < len(w) - 1 and w[i - 1] in vowels and w[i + 1] in vowels else c for i, c in enumerate(w))
    r1 = _region(w, vowels)
    r2 = _region(w, vowels, r1)
    r1 = max(3, r1)
    undouble = lambda x: x[:-1] if x.endswith(("kk", "dd", "tt")) else x

    def en(x: str, n: int) -> str:
        stem = x[:-n]
        return undouble(stem) if len(stem) >= r1 and stem and stem[-1] not in vowels and not stem.endswith("gem") else x

    if w.endswith("heden") and len(w) - 5 >= r1:
        w = w[:-5] + "heid"
    elif w.endswith("ene"):
        w = en(w, 3)
    elif w.endswith("en"):
        w = en(w, 2)
    elif w.endswith("se") and len(w) - 2 >= r1 and w[-3] not in vowels + "j":
        w = w[:-2]
    elif w.endswith("s") and len(w) - 1 >= r1 and w[-2] not in vowels + "j":
        w = w[:-1]
    gone = w.endswith("e") and len(w) - 1 >= r1 and w[-2] not in vowels
    if gone:
        w = undouble(w[:-1])
    if w.endswith("heid") and len(w) - 4 >= r2 and w[-5:-4] != "c":
        w = w[:-4]
        if w.endswith("en"):
            w = en(w, 2)
    e = _longest(w, ("end", "ing", "ig", "lijk", "baar", "bar"))
    if e and len(w) - len(e) >= r2:
        if e in ("end", "ing"):
            w = w[:-3]
            w = w[:-2] if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig") else undouble(w)
        elif e == "ig":
            w = w if w.endswith("eig") else w[:-2]
        elif e == "lijk":
            w = w[:-4]
            if w.endswith("e") and len(w) - 1 >= r1 and w[-2] not in vowels:
                w = undouble(w[:-1])
        elif e == "baar" or gone:
            w = w[: -len(e)]
    if len(w) > 3 and w[-1] not in vowels + "I" and w[-2] == w[-3] and w[-2] in "aeou" and w[-4] not in vowels:
        w = w[:-2] + w[-1]
    return w.lower()


# Endings; those under A need а or я before them.
_RU_GERUND_A, _RU_GERUND = "в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split()
_RU_ADJ = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_RU_PART_A, _RU_PART = "ем нн вш ющ щ".split(), "ивш ывш ующ".split()
_RU_VERB_A = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()
_RU_VERB = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
_RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def russian(word: str) -> str:
    vowels, w = "аеиоуыэюя", word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in vowels), len(w))
    r2 = _region(w, vowels, _region(w, vowels))

    def cut(x: str, free: Sequence[str], after_a: Sequence[str] = ()) -> str | None:
        """x without its longest ending, or None."""
        for e in sorted([*free, *after_a], key=len, reverse=True):
            if x.endswith(e) and len(x) - len(e) >= rv:
                if e in after_a and e not in free and not (len(x) - len(e) - 1 >= rv and x[: -len(e)].endswith(("а", "я"))):
                    continue
                return x[: -len(e)]
        return None

    got = cut(w, _RU_GERUND, _RU_GERUND_A)
    if got is not None:
        w = got
    else:
        w = cut(w, ("ся", "сь")) or w
        got = cut(w, _RU_ADJ)
        if got is not None:
            w = cut(got, _RU_PART, _RU_PART_A) or got
        else:
            got = cut(w, _RU_VERB, _RU_VERB_A)
            if got is None:
                got = cut(w, _RU_NOUN)
            w = w if got is None else got
    if w.endswith("и") and len(w) - 1 >= rv:
        w = w[:-1]
    for e in ("ость", "ост"):
        if w.endswith(e) and len(w) - len(e) >= r2:
            w = w[: -len(e)]
            break
    for e in ("ейше", "ейш"):
        if w.endswith(e) and len(w) - len(e) >= rv:
            w = w[: -len(e)]
            break
    if len(w) > rv and (w.endswith("нн") or w.endswith("ь")):
        w = w[:-1]
    return w


STEMMERS: dict[str, Callable[[str], str]] = {f.__name__: f for f in (english, german, swedish, norwegian, danish, french, spanish, dutch, russian)}
#: Names that analyzers may use; those without a stemmer here leave words as they are.
LANGUAGES = tuple("arabic danish dutch english finnish french german greek hungarian italian norwegian portuguese romanian russian spanish swedish tamil turkish".split())

# Common words that a language's `stop` filter drops.
STOP = {
    "english": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split(),
    "german": "aber alle als also am an auch auf aus bei bin bis bist da damit das dass dem den der des die dies doch du durch ein eine einem einen einer er es für hat hatte ich ihr im in ist ja kein man mein mit nach nicht noch nun nur ob oder ohne sehr sein sich sie sind so um und uns unter vom von vor war was wenn wer wie wir wird zu zum zur über".split(),
    "french": "à au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me même mes moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un une vos votre vous c d j l m n s t y".split(),
    "spanish": "a al algo ante como con cual de del desde donde el ella ellos en entre era es esa ese eso esta este esto fue ha hasta la las le les lo los me mi muy más ni no nos o para pero por que quien se ser si sin sobre su sus también te tu un una uno y ya yo él".split(),
    "swedish": "alla att av blev de dem den denna det detta du där efter ej eller en er ett för från ha hade han hans har hon i icke inte jag kan man med men mig min mot mycket ni nu när någon och om oss på sig sin som så till under upp ut var vi vid vilken än är över".split(),
    "norwegian": "alle at av ble da de den denne der det dette du eller en er et for fra ha han har hun hva i ikke jeg kan man med meg men min mot ned nei noe og om opp oss over på seg sin skal som til under ut var ved vi vil være å".split(),
    "danish": "af alle at blev da de den denne der det dette du efter eller en er et for fra ham han har havde hun i ikke jeg kan man med men mig min mod ned nu når og om op os over på sig skal som til ud under var ved vi vil være".split(),
    "dutch": "aan als bij dat de den der deze die dit door een en er ge haar had heb heeft hem het hier hij hun ik in is ja je kan maar me meer met mij mijn na naar niet nog nu of om omdat onder ons ook op over te tegen toch toen tot u uit uw van veel voor want was wat we wel werd wie wij worden ze zich zij zijn zo zonder zou".split(),
    "russian": "а без бы был была были было быть в вам вас весь во вот все вы где да для до его ее если есть же за и из или им их к как ко когда кто ли мне мы на над не него нет ни но ну о об он она они от по под при с со так также там то тот ты у уже чем что чтобы эта эти это я".split(),
    "italian": "a ad al alla anche che chi ci come con da dal dei del della di e ed era essere gli ha ho i il in io la le lei lo loro lui ma mi mio ne nei nel noi non o per perché più quale questo se si sono su sua sul suo ti tra tu un una uno vi voi è".split(),
    "portuguese": "a ao aos as até com como da das de depois do dos e ela ele em entre era essa esse esta este eu foi há isso já lhe mais mas me mesmo meu muito na nas nem no nos nós não o os ou para pela pelo por qual quando que quem se sem seu sua são só também te tem um uma você à é".split(),
}


def stem(word: str, language: str = "english") -> str:
    f = STEMMERS.get(language)
    return f(word) if f else word
