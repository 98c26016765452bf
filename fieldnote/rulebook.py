"""Fixed patterns for questions and for written answers, in the order they apply.

They are data: each operator that uses them takes a replacement as an argument.
"""

from __future__ import annotations

# ---------------------------------------------------------------- questions (fixed patterns)
# What a question is about: the first pattern that matches names the subject.
SUBJECT_RULES = [
    (
        r"\bjourney\b|\b(?:whole|entire|full) (?:path|process|hunt)\b|\bstep[- ]by[- ]step\b|"
        r"\blay ?out\b.*\b(?:path|steps|process|hunt)\b|\bwalk (?:me )?through\b|"
        r"\bwhere (?:does|do) (?:it|the hunt|search|people) (?:break|fail)",
        "journey",
    ),
    (
        r"^(?:how many|what is the number of) (?:core |adjacent )?(?:stories|records)"
        r"(?: are there)?\b(?!.*\b(?:stage|go wrong|fail|search))|how many different people",
        "corpus",
    ),
    (
        r"\b(?:clues?|typed?|search(?:ed)? for)\b.*\b(?:bring|brings|find|finds|return|returns|"
        r"show|shows)(?: up)? the photo|\bdoes (?:google photos|search) (?:bring up|find|return|show)",
        "stage:5",
    ),
    (
        r"\b(?:typed|type|typing|searched|search(?:ed)? for|tried)\b.*\b(?:fail\w*|didn't work|did not "
        r"work|no results?|returned nothing|nothing came up|wrong photos?|missed)\b",
        "stage:5",
    ),
    (r"\bforg[oe]t", "question:2.4"),
    (r"\bremember(?:s|ed)?\b", "question:2.1"),
    (r"\bhow many attempts|\bbefore (?:they |people )?give up|\bhow long do (?:they|people)", "question:8.1"),
    (r"\bhow (?:deep|far)\b.*\bscroll|\bscroll\w* through (?:the )?(?:search )?results", "question:6.6"),
    (r"\bwrong (?:year|date|month)\b|\bhard filter", "question:5.3"),
    (
        r"\b(?:understand|match|misread|misinterpret)\w*\b.*\b(?:search|typ(?:e|ed|es|ing)|"
        r"clues?|quer|words?)|\bsearch\b.*\b(?:understand|match)",
        "stage:5",
    ),
    (
        r"\b(?:words?|terms?|quer(?:y|ies)|phrases?|keywords?)\b.*\b(?:tried|typed|used|type|"
        r"search(?:ed)?)\b|\b(?:typed|type|tried|search(?:ed)? for)\b.*\bfirst\b|"
        r"\bwhat (?:\w+ ){0,2}(?:people|users|they) (?:\w+ ){0,2}(?:type|typed|search)|"
        r"\bformulate (?:a )?searches",
        "question:4.1",
    ),
    (r"\bfeel|\bfelt\b|\bemotion|\bfrustrat|\bupset\b|\bangry\b|\bsad\b|\bpanic", "question:7.4"),
    (
        r"\bhow (?:did|do|does) (?:they|people|users|someone) (?:finally |eventually )?find\b|"
        r"\bhow (?:they|people) (?:finally |eventually )?found\b|\bfound (?:the photo|it) in the end",
        "question:9.1",
    ),
    (r"\bgive up\b|\bgave up\b|\bgiving up\b|\babandon", "question:9.4"),
]
CLASS_RULES = [
    (r"\bboth\b.*\b(?:sentimental|practical|reasons)\b", "both"),
    (
        r"\butility\b|\bpractical\b|\breceipts?\b|\bdocuments?\b|\bbills?\b|"
        r"\bprescriptions?\b|\bwhiteboards?\b|\bid cards?\b|\binvoices?\b",
        "utility",
    ),
    (r"\bsentimental\b", "sentimental"),
]
ADJACENT_NEEDED = (
    r"(?i)\b(?:adjacent|exact(?:ly)?|knew|known|precise(?:ly)?|deleted|gone|lost|missing|never "
    r"backed|backed up|backup|all (?:the )?(?:cases|stories|posts)|overall|in total|altogether|"
    r"how many (?:stories|cases|posts|records|people)|every case|whole (?:set|collection))\b"
)
# Splits the evidence cannot give, by name.
MISSING_CUTS = [
    (
        r"\bmen\b|\bwomen\b|\bgender|\bage\b|\bage group|\bolder|\byounger|\bdemographic|"
        r"\bparents?\b.*\bvs\b",
        "age_or_gender",
    ),
    (r"\bindia(n)?\b|\busa\b|\bcountr|\bregion|\bcity|\bgeograph", "place"),
    (
        r"\bover time\b|\btrend|\bbefore\b.*\bafter\b|\bsince\b.*\bask photos|\bgot worse|"
        r"\bgetting (better|worse)",
        "time",
    ),
    (r"\bandroid\b.*\bios\b|\bios\b.*\bandroid\b|\biphone users\b|\bplatform", "device"),
    (r"\b(apple photos|icloud|samsung gallery|amazon photos|onedrive)\b", "other_products"),
]
OUT_OF_SCOPE = (
    r"(?i)\b(what(?:'s| is| are)?|which|how (?:much|many|big|large|often)|give me|tell me|"
    r"show me|calculate|estimate)\b[^?.]{0,70}?\b("
    r"success rate|failure rate|retrieval rate|abandonment rate|conversion|revenue|profit|"
    r"market share|daily active|monthly active|active users|users (?:does|do|have|has)|"
    r"number of users|(?:people|users) (?:use|using)|share price|valuation)\b"
)
TOPIC_RULES = [
    (
        r"\bsources?\b|\bsites?\b|\bplatforms?\b|\bwhere (?:did|do) (?:the )?(?:posts|data|"
        r"records) come|\breddit|\byoutube|\bquora|\bhacker ?news|\bapp store|\bgoogle play|"
        r"\bstack ?exchange|\bx \(twitter\)|\btwitter|\bhelp (?:forum|community)",
        "sources",
    ),
    (
        r"\bcollect\w*|\bscrap\w*|\bapify|\brobots|\bhow (?:was|were|did you) "
        r"(?:the )?(?:data|posts|records) (?:get|gathered|obtained|collected)|\bobtained",
        "collection",
    ),
    (
        r"\bset aside|\bexclu\w*|\bremoved|\bdropped|\bduplicat\w*|\bfiltered|\bwhat was "
        r"(?:left out|thrown out)|\btoo short",
        "setaside",
    ),
    (
        r"\bmethod\w*|\bhow (?:was|is|were|did) (?:this|it|the study|you)\b|\bhow it works|"
        r"\bcodebook|\bquestions? (?:the study|asked|you ask)|\bpipeline|\bbuilt|\bread (?:the "
        r"posts|each)|\bai readers?|\bcoders?|\breliab\w*|\bagree\w*|\btest cases?|\bblind",
        "method",
    ),
    (r"\bweights?\b|\bscor\w*|\brank\w*|\bsensitiv\w*|\bprioriti\w*|\bcriteri\w*", "scoring"),
    (r"\blimit\w*|\bweak\w*|\bcaveat|\bbias\w*|\btrust|\bhow reliable|\bshortcoming", "limits"),
    (r"\bgates?\b|\bquality checks?|\btests? (?:pass|it passed)|\bchecks? passed", "gates"),
    (
        r"\bsearch terms?|\bkeywords? (?:used|searched)|\blexicon|\bwhat (?:did you|was) "
        r"search(?:ed)? for|\bqueries used",
        "lexicon",
    ),
]
EVIDENCE_KINDS = [
    "prevalence", "ranking", "stage", "segment_split", "source_breakdown", "detail", "memory",
    "workaround", "robustness", "opportunity", "recommendation", "hypothesis", "coverage",
    "reliability", "theme", "composition", "verbatim", "method",
]
DEFAULT_QUERY = {
    "prevalence": "stage_prevalence", "ranking": "stage_prevalence", "stage": "stage_prevalence",
    "segment_split": "stage_by_photo_class", "source_breakdown": "stage_by_source",
    "memory": "memory", "workaround": "behaviours", "robustness": "source_divergence",
    "opportunity": "opportunities", "recommendation": "recommendation",
    "hypothesis": "interview_hypotheses", "coverage": "coverage", "reliability": "reliability",
    "theme": "emerging_themes", "composition": "funnel",
}

# ---------------------------------------------------------------- answers (fixed patterns)
CITATION = r"\[\[([a-z_]+)\|([^\]]+)\]\]"
QUOTE = r"[\"“]([^\"“”]{3,400})[\"”]"
NUMBER = r"(?U)(?<![\w.])(\d[\d,]*(?:\.\d+)?)\s*(%)?"
STRUCTURE = [
    r"(?U)\b[Ss]tages?\s+\d+(?:\s*(?:,|and|or|–|-|to)\s*\d+)*",
    r"(?U)\b(?:[Qq]uestions?\s+)?\(?\b(?:10|[0-9])\.\d\b\)?",
]
NUMBER_TOLERANCE = 0.011
STRUCTURAL_NUMBERS = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 30.0, 80.0, 60.0, 300.0, 0.6, 1000.0]
APPROXIMATELY = (
    r"(?i)\b(about|around|roughly|nearly|almost|over|more than|some|close to|"
    r"just over|just under|under)\s+$"
)
COUNT_OF = r"(?U)\b\d[\d,]* of \d[\d,]*\b"
SHARE = (
    r"(\d+(?:\.\d+)?)%\s*\((\d[\d,]*) of (\d[\d,]*)"
    r"|(\d[\d,]*) of (\d[\d,]*)(?:\s+[a-z]+){0,2}\s*\((\d+(?:\.\d+)?)%\)"
)
ROUGH_LABEL = r"(?i)directional|rough guide"
FLOOR_CLAIM = (
    r"(?i)(\d[\d,]*)\s+(?:stories|posts|cases)\b(?:(?!\d[\d,]*\s+(?:stories|posts|cases)\b)"
    r"[^.\n]){0,140}?too few \(under (\d+)\)"
)
FRACTIONS = {
    "one in twenty": 0.05, "one in ten": 0.10, "one in eight": 0.125, "one in seven": 1 / 7,
    "one in six": 1 / 6, "one in five": 0.20, "a fifth": 0.20, "one in four": 0.25,
    "a quarter": 0.25, "one in three": 1 / 3, "a third": 1 / 3, "two in five": 0.40,
    "half": 0.50, "three in five": 0.60, "two-thirds": 2 / 3, "two thirds": 2 / 3,
    "three-quarters": 0.75, "three quarters": 0.75, "four in five": 0.80, "nine in ten": 0.90,
}
FRACTION_MODIFIERS = (
    "about|around|roughly|nearly|almost|over|more than|under|less than|just over|just under|"
    "close to|some"
)
FRACTION_ABOVE = ["over", "more than", "just over"]
FRACTION_BELOW = ["nearly", "almost", "under", "less than", "just under", "close to"]
HALF_FORMED = (
    r"(?i)^half(?:[\-\u2010\u2011\u2012\u2013]\w|[\s]+(?:remembered|forgotten|recalled|formed|memor))"
)
MAJORITY = (
    r"(?i)\b(?:the majority|most (?:people|of them|of these|cases|posts|searchers|"
    r"of the (?:people|cases|posts))|mostly|mainly|usually|typically)\b"
)
CITED_SENTENCE = r"[^.!?\n]+(?:[.!?]+|$)(?:\s*\[\[[a-z_]+\|[^\]]+\]\])*"
VAGUE = (
    r"(?i)\b(?:most|mostly|majority|many|often|usually|commonly|common|typically|"
    r"rarely|rare|seldom|frequently|frequent|few|dominant|dominates|largest|biggest"
    r"|leading)\b"
)
REASONING = (
    r"(?i)\b(?:my read|likely|suggests?|probably|perhaps|may|might|could|"
    r"this means|reasoning|i think|would)\b"
)
SUPPORT = r"(?i)\d|“|\"|\bhandful\b|\bnone\b|\bone case\b|\bsingle case\b"
PROXY = (
    r"(?i)\b(success rate|failure rate|retrieval rate|fail(?:ure)? rate|"
    r"of (?:all )?(?:google photos )?users|of (?:all )?searches|of people who search|"
    r"of (?:all )?attempts|users (?:fail|succeed)|searches (?:fail|succeed))\b"
)
NEGATION = (
    r"(?i)\b(not|never|no|none|nor|neither|cannot|can't|isn't|aren't|"
    r"rather than|instead of|does not|do not|is not|are not|without)\b"
)
NEGATION_WINDOW = 160
LABEL_COLON = r"(?:^|(?<=[.!?]\s)|(?<=\]\]\s)|(?<=\n))\s*[*_]*([A-Z][A-Za-z' ]{0,28}?)[*_]*:\s"
SPEECH_END = (
    r"(?i)\b(wrote|writes|said|says|put it|posted|asked|asks|explained|"
    r"complained|added|recalled|described|admitted)\s*$"
)
SAID = (
    r"(?i)\b(wrote|writes|said|says|say|posted|asked|asks|complained|told|put it|"
    r"one person|someone|a poster|a user|people typed|typed|searched for)\b"
)
CODE_NAME = r"(?U)(?<![\w:/.\-])[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b"
JARGON = (
    r"\b(?:[Ss]tages?\s+\d+|[Cc]ore|[Aa]djacent|[Cc]orpus|[Cc]oded|[Cc]odebook|[Cc]oders?|"
    r"[Cc]ohort|[Dd]ataset|[Dd]irectional|[Kk]appa|[Mm]etric nodes?|[Pp]roxy|[Gg]ated|[Cc]rosstab|"
    r"[Rr]etrieval stor(?:y|ies)|[Uu]tility (?:photos?|stories)|"
    r"(?:[Qq]uestion|[Qq])\s*\d+\.\d+|FULL|PARTIAL|NONE)\b|κ|\[\s*[FSN]\d+\b(?:\s*\])?"
)
KIND = (
    r"(?:sentimental|utility|practical (?:photos?|ones|images)|unclear|kept as memories|"
    r"memory photos|information photos|photos kept for (?:their )?information|"
    r"for the information in them|why (?:it|the photo|the photos|they) (?:was|were) kept)"
)
COMPARATIVE = (
    r"(?:more|less|fewer|harder(?!\s+to\b)|easier(?!\s+to\b)|higher|lower|bigger|"
    r"larger|skews?|skewed|than|differently|different|unlike|whereas)"
)
SUPERLATIVE = r"(?:most|least|hardest|easiest|highest|lowest|mainly|mostly|biggest|largest|dominat\w*)"
KIND_WORDS = r"(?:kinds? of photos?|types? of photos?|photo(?:'s)? (?:kind|type)s?)"
KIND_COMPARE = (
    rf"(?i)\b{KIND}\b[^.;\n]{{0,60}}?\b{COMPARATIVE}\b|\b{COMPARATIVE}\b[^.;\n]{{0,40}}?\b{KIND}\b"
)
KIND_SUPERLATIVE = (
    rf"(?i)([^.;\n]{{0,24}})\b{KIND}\b[^.;\n]{{0,40}}\b{SUPERLATIVE}\b|"
    rf"\b{SUPERLATIVE}\b[^.;\n]{{0,40}}\b{KIND}\b"
)
KIND_DIFFER = (
    rf"(?i)\b(?:differ\w*|depends? on|the same|similar|alike)\b[^.;\n]{{0,40}}"
    rf"\b(?:{KIND_WORDS}|{KIND})\b|"
    rf"\b{KIND_WORDS}\b[^.;\n]{{0,40}}\b(?:differ\w*|the same|similar|alike)\b"
)
SCOPE = r"(?i)\b(?:for|among|within|in|about)\b"
CLOSING_QUESTION = r"^[*_][^*_]{3,200}\?[*_]$"
MAX_WORDS = 260
TERM_WORDS = 4
LABEL_WORDS = 6

# ---------------------------------------------------------------- statements (fixed patterns)
STATEMENT_NUMBER = r"(?U)(?<![\w.])\d+(?:[.,]\d+)?(?![\w])"
STATEMENT_PROXY = (
    r"(?i)(\d+%|\d+ of \d+|\bmost|\bmajority)[^.;]{0,50}\b(users|searches|attempts|people who search)\b"
)
STATEMENT_MOVES_SHARE = (
    r"(?i)\b(rais|increas|improv|reduc|lower|boost)\w*\b[^.;]{0,60}\bshare of\b[^.;]{0,30}\bstories"
)
STATEMENT_DENOMINATOR = r"\bof \d[\d,]*\b"
