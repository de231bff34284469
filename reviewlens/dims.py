"""Dictionaries, ordered category lists and cut-offs used by the operators.

They are small constants, so the DataFrames made from them are the only ones
this package broadcasts without asking for their size first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Needed as they are for equal results.

DRUG_FAMILIES = {
    "TCA": ["amitriptyline", "clomipramine", "coxepin", "cortriptyline", "imipramine", "dosulepin"],
    "MAOI": ["tranylcypromine", "moclobemide", "phenelzine", "selegiline", "isocarboxazid"],
    "SSRI": ["fluoxetine", "paroxetine", "sertraline", "citalopram", "escitalopram", "fluvoxamine"],
    "SNRI": ["venlafaxine", "duloxetine", "desvenlafaxine", "levomilnacipran", "milnacipran"],
    "Benzodiazepines": ["temazepam", "nitrazepam", "diazepam", "oxazepam", "alprazolam", "lorazepam"],
    "AtypicalAntipsychotics": [
        "aripiprazole", "olanzapine", "quetiapine", "risperidone", "ziprasidone", "clozapine",
    ],
    "GABA": ["gabapentin", "pregabalin", "tiagabine", "vigabatrin", "valproate", "carbamazepine"],
    "MixedAntidepressants": ["bupropion", "mirtazapine", "trazodone"],
}

RATINGS = ["Effectiveness", "EaseOfUse", "Satisfaction", "Overall"]
SENTIMENTS = ["negative", "neutral", "positive"]

AGE_REMAP = {"0-2": "00-02", "3-6": "03-06", "7-12": "07-12"}
AGE_SUFFIX = " yrs"
AGE_ORDER = [
    "00-02 yrs", "03-06 yrs", "07-12 yrs", "13-18 yrs", "19-24 yrs", "25-34 yrs",
    "35-44 yrs", "45-54 yrs", "55-64 yrs", "65-74 yrs", "75 or over yrs",
]
TIME_USING_DRUG_ORDER = [
    "less than 1 month", "1 to 6 months", "6 months to less than 1 year", "1 to less than 2 years",
    "2 to less than 5 years", "5 to less than 10 years", "10 years or more",
]

# score -> (negative at or below, positive at or above)
BANDS = {
    "Overall": (2.5, 4.0),
    "vader_compound": (-0.75, -0.2),
    "bert_compound": (-0.79, -0.2),
}

CUSTOM_STOP_WORDS = [
    "drug", "medication", "taking", "take", "feel", "would", "could", "not", "make", "get", "go",
    "mg", "like",
]
BRAND_STOP_WORDS = ["prozac", "paxil"]

REVIEW_COLUMNS = [
    "BrandName", "DrugCondition", "Drug", "GenName", "DrugFamily", "Condition", "IsPatient",
    "IsMale", "Age", "TimeUsingDrug", "Topic", "TopicName",
]

DATE_POSTED_FORMAT = "M/d/yyyy h:mm:ss a"

TOPIC_PROBABILITY_CUTOFF = 0.05
PHRASE_MIN_COUNT = 5
PHRASE_THRESHOLD = 10.0
NGRAM_MIN_DF = 0.01
NGRAM_MAX_DF = 0.6
POLYNOMIAL_DEGREE = 5
TOP_CATEGORIES = 20

# End of the fixed values.

ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now"
).split()

# A short lexicon for plain English; a full one is read with `sentiment.read_lexicon`.
LEXICON = {
    "amazing": 2.8, "awful": -2.0, "awesome": 3.1, "bad": -2.5, "best": 3.2, "better": 1.9,
    "calm": 1.3, "depressed": -2.3, "die": -2.9, "disgusting": -2.4, "excellent": 2.7,
    "good": 1.9, "great": 3.1, "haha": 2.0, "happy": 2.7, "hate": -2.7, "helped": 1.7,
    "helpful": 1.8, "horrible": -2.5, "idiot": -2.3, "improved": 2.1, "love": 3.2, "miserable": -2.2,
    "nausea": -1.5, "nice": 1.8, "pain": -2.3, "pathetic": -2.7, "relief": 2.1,
    "sad": -2.1, "sick": -2.3, "stupid": -2.4, "suicidal": -3.4, "terrible": -2.1, "trash": -1.8,
    "useless": -1.8, "wonderful": 2.7, "worse": -2.1, "worst": -3.1, "worthless": -1.9,
}
BOOSTERS = {
    "absolutely": 0.293, "completely": 0.293, "especially": 0.293, "extremely": 0.293,
    "incredibly": 0.293, "really": 0.293, "so": 0.293, "totally": 0.293, "very": 0.293,
    "almost": -0.293, "barely": -0.293, "hardly": -0.293, "slightly": -0.293, "somewhat": -0.293,
}
NEGATIONS = (
    "aint arent cannot cant couldnt didnt doesnt dont hadnt hasnt havent isnt mightnt mustnt "
    "neither never no none nope nor not nothing nowhere rarely seldom shouldnt wasnt werent without "
    "wont wouldnt"
).split()

LEMMAS = {
    "was": "be", "were": "be", "is": "be", "are": "be", "been": "be", "has": "have", "had": "have",
    "does": "do", "did": "do", "felt": "feel", "made": "make", "took": "take", "taken": "take",
    "got": "get", "went": "go", "gone": "go", "better": "good", "best": "good", "worse": "bad",
    "worst": "bad", "pills": "pill", "days": "day", "weeks": "week", "months": "month",
    "years": "year", "effects": "effect", "doctors": "doctor", "doses": "dose", "helped": "help",
    "helps": "help", "works": "work", "worked": "work", "others": "other", "these": "this",
    "those": "that", "an": "a",
}


def drug_names() -> list[str]:
    """Dictionary names in dictionary order, the order first-match rules follow."""
    return [name for names in DRUG_FAMILIES.values() for name in names]


def drug_family_map() -> dict[str, str]:
    return {name: family for family, names in DRUG_FAMILIES.items() for name in names}


def dictionary_table(spark: SparkSession, families: dict[str, list[str]] = DRUG_FAMILIES) -> DataFrame:
    """`(ord, name, family)` in dictionary order."""
    pairs = [(name, family) for family, names in families.items() for name in names]
    rows = [(i, name, family) for i, (name, family) in enumerate(pairs)]
    return F.broadcast(spark.createDataFrame(rows, "ord int, name string, family string"))


def ordered_labels(spark: SparkSession, labels: list[str]) -> DataFrame:
    """`(ord, label)` of an ordered category."""
    return F.broadcast(spark.createDataFrame(list(enumerate(labels)), "ord int, label string"))


def word_weights(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(weights.items()), "token string, weight double"))


def lemma_table(spark: SparkSession, lemmas: dict[str, str] = LEMMAS) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(lemmas.items()), "token string, lemma string"))
