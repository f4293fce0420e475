"""The signals, their bands by language, opener classes and sentence patterns."""

# Signal | family | centre | spread | direction (1: higher is machine-like) | weight, in their natural order.
SIGNALS = """
burstiness | Rhythm | 0.62 | 0.16 | -1 | 1.4
sentSd | Rhythm | 9.0 | 3.0 | -1 | 1.0
sentMean | Rhythm | 19 | 6.5 | 1 | 0.5
sentKurt | Rhythm | 4.2 | 2.0 | -1 | 0.6
sentSkew | Rhythm | 0.85 | 0.55 | -1 | 0.4
shortRate | Rhythm | 0.16 | 0.09 | -1 | 1.0
longRate | Rhythm | 0.09 | 0.06 | -1 | 0.6
bandRate | Rhythm | 0.34 | 0.11 | 1 | 1.1
surpMean | Predictability | 10.6 | 1.1 | -1 | 1.3
surpSd | Predictability | 1.45 | 0.45 | -1 | 1.4
spikeRate | Predictability | 0.13 | 0.06 | -1 | 0.8
flatRun | Predictability | 3.6 | 1.6 | 1 | 0.7
oovRate | Predictability | 0.27 | 0.09 | -1 | 0.4
zipfDev | Predictability | 0.16 | 0.08 | -1 | 0.5
mattr | Lexicon | 0.74 | 0.06 | 1 | 0.7
hapax | Lexicon | 0.44 | 0.09 | -1 | 0.9
yulesK | Lexicon | 105 | 35 | 1 | 0.5
wordLenH | Lexicon | 2.35 | 0.22 | -1 | 0.5
funcRate | Lexicon | 0.485 | 0.045 | 1 | 0.6
rep5 | Lexicon | 0.008 | 0.010 | 1 | 0.6
discourse | Register | 6.5 | 3.5 | 1 | 1.2
regMark | Register | 1.2 | 1.2 | 1 | 1.3
hedge | Register | 14 | 6 | 1 | 0.7
contraction | Register | 7 | 6 | -1 | 0.9
firstPerson | Register | 18 | 14 | -1 | 0.7
intens | Register | 7 | 4 | -1 | 0.4
passive | Register | 0.19 | 0.10 | 1 | 0.6
exclaimQ | Register | 0.07 | 0.06 | -1 | 0.5
openerRep | Register | 0.22 | 0.09 | 1 | 0.9
openerH | Register | 1.6 | 0.35 | -1 | 0.6
paraCv | Structure | 0.55 | 0.20 | -1 | 0.9
gradeSd | Structure | 2.4 | 0.9 | -1 | 1.0
flesch | Structure | 52 | 16 | -1 | 0.3
listRate | Structure | 0.06 | 0.09 | 1 | 0.5
headRate | Structure | 0.3 | 1.0 | 1 | 0.5
paraSentCv | Structure | 0.52 | 0.20 | -1 | 0.6
emDash | Typography | 1.2 | 1.6 | 1 | 0.8
curly | Typography | 0.5 | 0.35 | 1 | 0.3
doubleSpace | Typography | 0.06 | 0.12 | -1 | 0.3
typo | Typography | 2.0 | 2.0 | -1 | 0.9
unicode | Typography | 0.05 | 0.4 | 1 | 0.4
"""

# centre/spread of other languages than English, in the order es, pt, fr; a dash keeps the English band.
BANDS = """
sentMean | 24/7.5 | 23/7.5 | 23/7.5
sentSd | 11/4 | 10.5/4 | 11/3.5
bandRate | .30/.11 | .31/.11 | .31/.11
shortRate | .13/.08 | .13/.08 | .14/.08
longRate | .12/.09 | .12/.09 | .13/.08
funcRate | .45/.05 | .46/.05 | .50/.05
firstPerson | 9/8 | 10/8 | 12/10
hedge | 12/6 | - | -
discourse | 8/4 | - | -
passive | .11/.07 | .12/.07 | .15/.09
oovRate | .32/.10 | .32/.10 | .33/.10
surpMean | 10.9/1.2 | 10.9/1.2 | 10.8/1.2
flesch | 62/16 | 60/16 | 58/16
emDash | 2.4/2.2 | - | -
"""

# First words of sentences by class.
OPENERS = {
    "en": ("the a an this that these those his her its their our my your", "i we you he she they it one someone everyone", "and but or so yet nor because although though while if when since as"),
    "es": ("el la los las un una unos unas este esta estos estas ese esa esos esas aquel aquella su sus mi mis tu tus nuestro nuestra", "yo nosotros nosotras tú usted ustedes él ella ellos ellas uno alguien todos me te le lo la nos les los las se", "y e o u pero sino porque aunque mientras si cuando como pues ya que"),
    "pt": ("o a os as um uma uns umas este esta estes estas esse essa esses essas aquele aquela seu sua seus suas meu minha nosso nossa", "eu nós você vocês ele ela eles elas alguém todos me te lhe lhes nos se o a os as", "e ou mas porém porque embora enquanto se quando como pois já"),
    "fr": ("le la les un une des ce cet cette ces son sa ses mon ma mes notre nos leur leurs", "je nous tu vous il elle ils elles on quelqu'un tous me te se lui leur y en cela ça", "et ou mais car parce puisque bien lorsque quand comme si tandis"),
}
ADVERB_END = {"en": "ly", "es": "mente", "pt": "mente", "fr": "ment"}

# Patterns of passives and of the first person; \b and \w are those of ASCII.
PASSIVE = {
    "en": r"\b(is|are|was|were|be|been|being|am)\s+(?:\w+ly\s+)?(\w{3,}(?:ed|en)|done|made|given|taken|shown|seen|held|known|found|used|built|sent|kept|left|brought|put|set)\b",
    "es": r"\b(es|son|era|eran|fue|fueron|ser|sido|sea|sean|fuera|fueran|será|serán|sería|serían|siendo|está|están|estaba|estaban|quedó|quedaron)\s+(?:\w+mente\s+)?\w{3,}(?:ado|ada|ados|adas|ido|ida|idos|idas|to|ta|cho|cha)\b|\bse\s+\w{3,}(?:ó|aron|ieron|a|an|e|en)\b|\b\w{4,}(?:ar|er|ir)se\b",
    "pt": r"\b(é|são|era|eram|foi|foram|ser|sido|seja|sejam|fosse|fossem|será|serão|seria|seriam|sendo|está|estão|estava|estavam)\s+(?:\w+mente\s+)?\w{3,}(?:ado|ada|ados|adas|ido|ida|idos|idas|to|ta)\b|\bse\s+\w{3,}(?:ou|aram|eram|a|am|e|em)\b|\b\w{4,}(?:ar|er|ir)-se\b",
    "fr": r"\b(est|sont|était|étaient|fut|furent|être|été|sera|seront|serait|seraient|soit|soient)\s+(?:\w+ment\s+)?\w{3,}(?:é|ée|és|ées|i|ie|is|ies|u|ue|us|ues|it|ite)\b|\bse\s+(?:\w+ment\s+)?\w{3,}(?:e|ent|é|ait)\b",
}
FIRST_PERSON_IN = {
    "en": r"\b(i|we|my|our|me|us)\b",
    "es": r"\b(yo|me|mí|mi|mis|nos|nosotros|nosotras|nuestro|nuestra|nuestros|nuestras|conmigo)\b",
    "pt": r"\b(eu|me|mim|meu|minha|meus|minhas|nós|nos|nosso|nossa|nossos|nossas|comigo)\b",
    "fr": r"\b(je|j'|me|moi|mon|ma|mes|nous|notre|nos)\b",
}

# Constant, words and syllables of the reading ease.
READING_EASE = {"en": (206.835, 1.015, 84.6), "es": (206.84, 1.02, 60.0), "pt": (206.84, 1.02, 60.0), "fr": (207.0, 1.015, 73.6)}

# Signal ; its label ; its unit, in their natural order.
LABELS = """
burstiness ; Burstiness ; CV
sentSd ; Sentence length σ ; words
sentMean ; Sentence length μ ; words
sentKurt ; Length kurtosis ;
sentSkew ; Length skew ;
shortRate ; Short sentences ; < 8 words
longRate ; Long sentences ; > 35 words
bandRate ; Mid-band concentration ; 15–28 words
surpMean ; Mean surprisal ; bits/word
surpSd ; Surprisal variance ; bits
spikeRate ; Surprisal spikes ; share
flatRun ; Longest flat run ; sentences
oovRate ; Out-of-list words ; share
zipfDev ; Zipf slope deviation ; |Δs|
mattr ; MATTR (w=50) ;
hapax ; Hapax legomena ; share
yulesK ; Yule's K ;
wordLenH ; Word-length entropy ; bits
funcRate ; Function-word rate ; share
rep5 ; Repeated 5-grams ; share
discourse ; Discourse markers ; per 1k
regMark ; Register markers ; per 1k
hedge ; Hedges ; per 1k
contraction ; Contractions ; per 1k
firstPerson ; First person ; per 1k
intens ; Intensifiers ; per 1k
passive ; Passive constructions ; share of sent.
exclaimQ ; ! and ? endings ; share of sent.
openerRep ; Opener repetition ; share
openerH ; Opener entropy ; bits
paraCv ; Paragraph length CV ;
gradeSd ; Readability σ ; FK grades
flesch ; Flesch reading ease ;
listRate ; List scaffolding ; share of lines
headRate ; Markup residue ; per 1k
paraSentCv ; Sentences per paragraph CV ;
emDash ; Em dashes ; per 1k
curly ; Quote consistency ;
doubleSpace ; Double space after period ; share
typo ; Slip rate ; per 1k
unicode ; Invisible characters ; per 1k
"""
