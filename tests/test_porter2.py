import pytest

from pairgram.functions import porter2

# Words and stems as published with the English stemmer.
PUBLISHED = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist
consistent consist consistently consist consisting consist consists consist consolation consol consolations consol consolatory consolatori
console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid consoling consol
consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu
conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir
constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee
kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife
knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob knock knock
knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
""".split()
RULES = """
gas gas this this gaps gap kiwis kiwi ties tie cries cri dies die hoped hope hopped hop hopping hop luxuriated luxuri cry cri by by say say
generate generat general general generically generic communism communism arsenal arsenal news news skies sky dying die succeeding succeed
rational ration relational relat digitizer digit hopefulness hope formality formal sensibility sensibl apology apolog quickly quick fully fulli
electricity electr hopeful hope goodness good adjustment adjust replacement replac adoption adopt opinion opinion effective effect
controlling control rolling roll rate rate cease ceas probate probat youth youth boyish boyish flying fli dog's dog dogs' dog be be inning inning
""".split()


@pytest.mark.parametrize("words", [PUBLISHED, RULES])
def test_stems(words):
    pairs = list(zip(words[::2], words[1::2]))
    assert [(w, porter2.stem(w)) for w, _ in pairs] == pairs


def test_vocabulary_is_stemmed_once_and_joined_back(spark):
    rows = spark.createDataFrame([("knitting",), ("knits",), ("knits",), (None,), ("漢字",), ("naïveté",)], "token string")
    got = {r.token: r.stem for r in porter2.stem_table(rows).collect()}
    assert got["knits"] == got["knitting"] == "knit" and got["漢字"] == "漢字" and len(got) == 4
