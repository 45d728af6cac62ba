"""Published word lists, rules and patterns that scores and labels must agree with. Text only, no logic."""

# Word lists of Sharpe et al. (2022), table A2.
POSITIVE = """
assurance assure attain attractive auspicious backing befitting beneficial beneficiary benefit benign better bloom bolster boom boost bountiful bright
buoyant calm celebrate coherent comeback comfort comfortable commend compensate composure concession concur conducive confide confident constancy
constructive cooperate coordinate credible decent definitive deserve desirable discern distinction distinguish durability eager earnest ease easy
encourage encouragement endorse energetic engage enhance enhancement enjoy enrichment enthusiasm enthusiastic envision excellent exuberance exuberant
facilitate faith favor favorable feasible fervor filial flatter flourish fond foster friendly gain generous genuine good happy heal healthy helpful
hope hopeful hospitable imperative impetus impress impressive improve improvement inspire irresistible joy liberal lucrative manageable mediate mend
mindful moderation onward opportunity optimism optimistic outrun outstanding overcome paramount particular patience patient peaceful persuasive
pleasant please pleased plentiful plenty positive potent precious pretty progress progressive prominent promise prompt proper prosperity rally readily
reassure receptive reconcile refine reinstate relaxation reliable relief relieve remarkable remarkably repair rescue resolve resolved respectable
respite restoration restore revival revive ripe rosy salutary sanguine satisfactory satisfy sound soundness spectacular stabilize stable steadiness
steady stimulate stimulation subscribe succeed success successful suffice suit support supportive surge surpass sweeten sympathetic sympathy synthesis
temperate thorough tolerant tranquil tremendous undoubtedly unlimited upbeat upgrade uplift upside upward valid viable victorious virtuous vitality
warm welcome
""".split()
NEGATIVE = """
adverse afflict alarming apprehension apprehensive awkward bad badly bitter bleak bug burdensome corrosive danger daunting deadlock deficient depress
depression destruction devastation dim disappoint disappointment disaster discomfort discouragement dismal disrupt disruption dissatisfied distort
distortion distress doldrums downbeat emergency erode fail failure fake falter feeble feverish fragile gloom gloomy grim harsh havoc hit horrible hurt
illegal insecurity insidious instability interfere jeopardize jeopardy lack languish loss mishap negative nervousness offensive painful paltry
pessimistic plague plight poor recession sank scandal scare sequester sluggish slump sour sputter stagnant standstill struggle suffer terrorism threat
tragedy tragic trouble turmoil unattractive undermine undesirable uneasiness uneasy unfavorable unforeseen unprofitable unrest violent war
""".split()

# Tables A5 to A10 of Gardner et al. (2022). A rule needs all of its patterns.
UNINFORMATIVE = [
    (r"\bwill\b", r"\bassess\b", "as needed",),
    (r"\bwill\b", r"\bmonitor\b", "as needed",),
    ("promote a stronger", "as announced",),
    (r"\breview\b", r"\bsize\b", r"\bcomposition\b",),
    ("promote a stronger", "dual mandate",),
    (r"\bsizable\b", "still increasing holdings",),
    (r"\brecognize\b", "below its 2 percent objective",),
    (r"\bexpect\b", "gradual adjustments", r"will\s+\w+\s+(?:strengthen|remain strong)",),
    ("appropriate policy accommodation", "dual mandate",),
    ("dual mandate", "purchasing additional", "agency mortgage.backed securities",),
    ("long.term prospects", "unusual forces", "demand abate",),
    (r"sustain\w*\s+\w*\s*expansion", "symmetric 2 percent objective",),
    ("federal reserve", "employ all available tools|using its balance sheet",),
    (r"today's\s+.*?\s+action", r"\bhelp\b",),
]
#: (patterns, score)
POLICY = [
    (("policy accommodation", "maintained",), -1),
    (("continue its purchases",), -1),
    (("ready to expand", "purchase",), -1),
    (("await more evidence", "pace of its purchases",), -1),
    ((r"\bwill act\b", "as needed",), -1),
    ((r"\bbe patient\b",), 0),
    ((r"\bbelieve\b", "policy accommodation", "removed",), 1),
    (("firming", r"\bneed\b",), 1),
    ((r"\bexpects\b", "increases in the target range",), 1),
    ((r"\bjudges\b", "increases in the target range",), 1),
    ((r"\bwarrant\w*\b", "gradual increases",), 1),
    (("balance sheet normalization",), 1),
    (("end purchase", "improvement",), 1),
    ((r"\breduce\b", "purchase",), 1),
    (("complete|moderate", "purchase", "improvement",), 1),
    (("decides to", "remove policy accommodation",), 1),
]
#: (pattern, score, category)
OVERRIDES = [
    ("downside risks? to the outlook.*labor market.*diminish", 1, "labor"),
    ("declined? but remains elevated", 1, "labor"),
    ("declined? notably in recent months but remains elevated", 1, "labor"),
    ("declined? somewhat since the summer.*remains elevated", 1, "labor"),
    ("deterioration in (?:the )?labor market is abating", 1, "labor"),
    ("underutilization of labor resources continues to diminish", 1, "labor"),
    ("although job losses have slowed.*new hiring has lagged", 0, "labor"),
    ("despite the rise in energy prices.*inflation.*expectations have eased", -1, "inf"),
    ("the risk of inflation becoming undesirably low", -1, "inf"),
    ("pace of economic recovery is likely to be modest", -1, "out"),
    ("recovery is continuing.*insufficient to bring down unemployment", -1, "out"),
    ("recovery is continuing.*insufficient.*significant improvement in labor", -1, "out"),
    ("recovery is continuing at a moderate pace.*more slowly", -1, "out"),
    ("expanding.*remains constrained", -1, "out"),
    ("stabilizing but remains constrained", -1, "out"),
    ("picked up recently but remains constrained", -1, "out"),
    ("increasing.*but remains constrained", -1, "out"),
    ("increasing gradually.*remains constrained", -1, "out"),
    ("solid pace of spending growth has slowed", -1, "out"),
    ("rising.*though less rapidly than earlier in the year", -1, "out"),
    ("picked up late last year.*remains constrained", -1, "out"),
    ("rising at a somewhat slower pace", -1, "out"),
    ("improvement.*from a depressed level", -1, "out"),
    ("fiscal policy is restraining economic growth.*extent of restraint", 0, "out"),
    ("hurricane.related disruptions", 0, "out"),
    ("warrant.*(?:keeping|exceptionally low).*federal funds rate", 0, "out"),
    ("expand for a time at a pace below the productivity", 0, "out"),
]
#: (keyword, word, stem or phrase, sign, category)
TOPICS = [
    ("inflation", "word", 1, "inf"),
    ("price", "word", 1, "inf"),
    ("cost", "word", 1, "inf"),
    ("employers", "word", 1, "labor"),
    ("employment", "word", 1, "labor"),
    ("job gains", "phrase", 1, "labor"),
    ("job losses", "phrase", -1, "labor"),
    ("labor", "word", 1, "labor"),
    ("hiring", "word", 1, "labor"),
    ("underutilization of labor resources", "phrase", -1, "labor"),
    ("unemployment", "word", -1, "labor"),
    ("utilization of the pool of available workers", "phrase", 1, "labor"),
    ("business conditions", "phrase", 1, "out"),
    ("business outlook", "phrase", 1, "out"),
    ("confidence", "word", 1, "out"),
    ("consumption", "word", 1, "out"),
    ("strengthening in final demand", "phrase", 1, "out"),
    ("demand", "word", 1, "out"),
    ("econom", "stem", 1, "out"),
    ("expenditures", "word", 1, "out"),
    ("export", "word", 1, "out"),
    ("income", "word", 1, "out"),
    ("indicators", "word", 1, "out"),
    ("investment spending", "phrase", 1, "out"),
    ("investment", "word", 1, "out"),
    ("output", "word", 1, "out"),
    ("production", "word", 1, "out"),
    ("sales", "word", 1, "out"),
    ("sentiment", "word", 1, "out"),
    ("spending", "word", 1, "out"),
    ("bank lending", "phrase", 1, "fin"),
    ("credit", "word", 1, "fin"),
    ("financial", "word", 1, "fin"),
]
#: Modifiers by category and polarity: stems, words, phrases and patterns.
MODIFIERS = {
    "labor": {
        "pos": {
            "stems": ["elevat", "expand", "improv", "increas", "rebound", "strength"],
            "words": ["gains", "high", "rise", "rising", "rose", "risen", "solid", "strong", "upward", "up"],
            "phrases": ["pick up", "picking up", "picked up", "record expansion"],
        },
        "neu": {
            "words": ["balance", "mix", "stable", "stabilizing", "steady", "unchanged"],
            "phrases": ["little change"],
        },
        "neg": {
            "stems": ["declin", "deteriorat", "diminish", "disappoint", "inhibit", "restrain", "underutiliz"],
            "words": ["losses", "low", "modest", "moderated", "slow", "subdued", "weak"],
            "phrases": ["reluctant to add", "set back"],
            "special": [r"\bsoft\b(?!ware)"],
        },
    },
    "inf": {
        "pos": {
            "stems": ["elevat", "expand", "foster", "height", "improv", "increas", "persist", "sustain", "strength", "high"],
            "words": ["pressure", "rise", "rising", "rose", "risen", "solid", "strong", "upward", "up"],
            "phrases": ["pick up", "picking up", "picked up", "moderate ", "risk remain", "upside risk"],
        },
        "neu": {
            "words": ["balance", "contain", "stable", "stabilizing", "steady", "unchanged", "volatility", "uncertain"],
            "phrases": ["equal probability", "little change"],
        },
        "neg": {
            "stems": ["damp", "declin", "diminish", "restrain"],
            "words": ["below", "down", "easing", "low", "modest", "moderated", "muted", "reduction", "slow", "subdued", "weak"],
            "phrases": ["set back"],
            "special": [r"\bease\b", r"\bsoft\b(?!ware)"],
        },
    },
    "fin": {
        "pos": {
            "words": ["supportive"],
        },
        "neu": {
            "words": ["unchanged"],
        },
        "neg": {
            "stems": ["strain", "stress"],
            "words": ["tight", "volatile", "turmoil"],
        },
    },
    "out": {
        "pos": {
            "stems": ["advanc", "bolster", "expand", "improv", "increas", "rebound", "strength"],
            "words": ["gains", "high", "moderate", "rise", "rising", "rose", "risen", "solid", "strong", "upward"],
            "phrases": ["growing at a moderate pace", "remains firm", "firm", "firmer", "grow at a solid pace", "pick up", "picking up", "picked up",
                "record expansion"],
        },
        "neu": {
            "words": ["abating", "balance", "evolve", "mix", "same", "stable", "stabilizing", "sustain", "tentative"],
            "phrases": ["leveling out", "temporarily depressed"],
        },
        "neg": {
            "stems": ["contract", "damp", "decelerat", "depress", "declin", "deteriorat", "diminish", "disappoint", "erod", "inhibit", "restrain",
                "sluggish", "uncertain", "weigh"],
            "words": ["below", "cooling", "cut", "down", "drag", "flat", "gap", "hesitancy", "low", "modest", "pause", "reduction", "shortfall",
                "slow", "slump", "subdued", "weak"],
            "phrases": ["dislocation", "disruption", "increasing less rapidly", "might not be strong enough", "moderating", "moderation",
                "moderated", "remain moderate", "more moderate", "set back", "yet to exhibit sustainable growth", "weigh on", "weighing on"],
            "special": [r"\bsoft\b(?!ware)"],
        },
    },
}

# Keywords and patterns of the rule-based labels.
TOPIC_KEYWORDS = {
    "inflation": ["inflation", "inflationary", "price level", "price stability", "price pressure", "pce", "cpi", "deflation", "disinflation",
        "price index", "consumer price", "core inflation"],
    "employment": ["employment", "unemployment", "labor market", "labour market", "payroll", "job gain", "job loss", "job opening", "hiring",
        "labor force", "workforce", "worker", "wage", "jobless", "nonfarm", "jolts"],
    "economic_activity": ["gdp", "output", "economic growth", "economic activity", "consumption", "spending", "demand", "production", "investment",
        "business conditions", "business outlook", "retail sales", "industrial production", "housing", "export", "import", "econom", "recession",
        "expansion", "recovery"],
    "financial_conditions": ["financial condition", "financial market", "financial stability", "credit", "spread", "yield curve", "equity",
        "stock market", "bank lending", "liquidity", "funding", "repo", "mortgage", "asset price", "leverage", "financial stress",
        "tightening condition", "easing condition"],
    "monetary_policy": ["federal funds rate", "fed funds", "policy rate", "interest rate", "monetary policy", "accommodation", "taper",
        "asset purchase", "balance sheet", "qe", "quantitative easing", "forward guidance", "liftoff", "rate hike", "rate cut", "policy stance",
        "ioer", "ior", "on rrp", "overnight reverse", "discount rate"],
    "macro": ["global", "international", "foreign", "fiscal", "government spending", "federal budget", "deficit", "national debt", "trade balance",
        "geopolit", "europe", "china", "emerging market", "imf", "world economy", "cross-border"],
}
HYPOTHETICAL = (
    r"\b(if\b|were to|should (?:inflation|employment|growth|conditions|the economy|it|they|we)|in the event (?:that|of)|contingent|assuming that|"
    r"provided that|suppose|what if|hypothetically)\b"
)
FORWARD = (
    r"\b(will|would|shall|going to|expect\w*|anticipat\w*|project\w*|forecast\w*|predict\w*|likely to|expected to|anticipated to|poised to|set to|"
    r"plan to|intend to|may\b|might\b|could\b|going forward|ahead|outlook|upcoming|in coming|coming months|coming quarters|next (?:year|quarter|"
    r"month)|by (?:year.end|mid.year)|over the (?:next|coming))\b"
)
BACKWARD = (
    r"\b(was|were|had\b|rose|fell|declined|increased|decreased|grew|contracted|expanded|improved|deteriorated|strengthened|weakened|last year|"
    r"last quarter|last month|in \d{4}|previously|historically|in recent (?:months|quarters|years)|over the past|has (?:been|risen|fallen|"
    r"declined|increased|grown|improved)|have (?:been|risen|fallen))\b"
)
PRESENT = r"\b(is\b|are\b|has\b|have\b|continues|remains|stands|represents|currently|at present|today|now\b|ongoing|remain\w*)\b"
HAWKISH_STRONG = (
    r"(significantly restrict\w*|well above (?:neutral|2 percent|target)|substantially (?:above|tighten|restrict)\w*|aggressive\w* tighten|"
    r"very restrict\w*|highly restrict\w*|deeply restrict\w*)"
)
HAWKISH = (
    r"\b(tighten\w*|restrict\w*|normaliz\w*|above neutral|above (?:2|two) percent|rate (?:hike|increase|rise|rises)|hike\w*|taper\w*|"
    r"reduc\w* (?:purchase|asset purchase|balance sheet)|remov\w* accommodation|end (?:purchase|QE)|balance sheet (?:reduction|runoff|"
    r"normaliz\w*)|quantitative tighten|QT\b|lift.?off|liftoff)\b"
)
DOVISH_STRONG = (
    r"(significant accommodation|substantial accommodation|emergency (?:rate )?cut|deeply accommodativ\w*|well below (?:neutral|target|2 percent)|"
    "lower for longer|maximum policy accommodation|unprecedented stimulus)"
)
DOVISH = (
    r"\b(accommodat\w*|stimulus\b|eas\w+ (?:monetar|policy)|maintain (?:low|accommodat\w*|current) (?:rate|stance|policy)|cut (?:rate|"
    r"interest rate)|lower (?:rate|interest rate)|reduc\w* (?:rate|interest rate|fed fund)|zero lower bound|ZLB\b|asset purchas\w*|"
    r"quantitative eas\w*|\bQE\b|forward guidance|remain\w* patient|ample accommodation|policy support\b|supportive (?:monetary|"
    r"financial) (?:policy|condition))\b"
)
UNCONDITIONAL = (
    r"\b(will\b|shall\b|commit\w*|pledge\w*|resolv\w* to|determin\w* to|will not\b|will maintain|will continue|we are prepared to|stand ready|"
    r"ready to|prepared to)\b"
)
CONDITIONAL = (
    r"\b(if\b|provided that|as long as|subject to|contingent|in the event|when (?:inflation|employment|conditions|growth)|should (?:inflation|"
    r"conditions|growth|the economy)|depending on|based on data|data.?dependent|data.?driven|adjust (?:as|based)|monitor\w* and|assess\w* (?:and|"
    r"whether)|conditional on|as appropriate)\b"
)
SHORT_TERM = (
    r"\b(near.?term|short.?term|next (?:few |coming )?(?:months?|quarters?|weeks?)|this (?:year|quarter|month)|over (?:the )?(?:next|"
    "coming) (?:few )?(?:months?|quarters?)|in (?:the )?(?:near|immediate) future|upcoming|imminent|by (?:year.?end|mid.?year|end of the year)|"
    r"in the (?:next|coming) (?:few )?(?:months?|quarters?))\b"
)
LONG_TERM = (
    r"\b(long.?(?:er|run|term)|over (?:the )?(?:medium|longer).?(?:term|run)|structural|secular|in the (?:long|longer) run|over time\b|"
    r"sustained\w*|persist\w*|decade|years ahead|long.?standing|neutral (?:rate|interest rate)|longer.?run (?:rate|level|normal|objective|goal)|"
    r"trend growth|potential output)\b"
)
RISK_DOWN = (
    r"\b(downside risk|risks? (?:are )?(?:weighted )?(?:to the )?downside|skewed (?:to the )?downside|weighted (?:to the )?downside|headwind\w*|"
    r"vulnerabilit\w*|deteriorat\w* (?:outlook|conditions|risks?)|risks? (?:remain )?elevat\w*|tail risk|significant downside)\b"
)
RISK_SYMMETRIC = (
    r"\b(balanced risks?|symmetric(?:al)?|two.?sided|equal\w* (?:balance|probability)|roughly balanced|broadly balanced|risks? (?:are )?balanced|"
    r"upside and downside|both (?:upside and downside|directions))\b"
)
RISK_UP = (
    r"\b(upside risk|risks? (?:are )?(?:weighted )?(?:to the )?upside|skewed (?:to the )?upside|weighted (?:to the )?upside|overheat\w*|"
    r"inflationary pressure|above.target|significant upside)\b"
)
ELEVATED = (
    r"\b(uncertain\w*|volatil\w*|unpredictabl\w*|wide range|significant(?:ly)? uncert\w*|hard to (?:predict|assess|know)|difficult to (?:assess|"
    r"predict|gauge)|range of (?:views|outcomes|estimates)|considerable uncertainty|marked(?:ly)? uncert\w*|substantial uncertainty|"
    r"unusual(?:ly)? (?:high|large|elevated) uncertainty)\b"
)
CONTESTED = (
    r"\b(however\b|on the other hand|but\b|although\b|despite\b|yet\b|while\b|notwithstanding|even so|nevertheless|nonetheless|mixed\b|"
    r"conflicting|divergent|debate\b|disagree\w*|on balance|in contrast|conversely|that said|having said)\b"
)
QUICK_POSITIVE = r"\b(improv\w*|strength\w*|solid|robust|strong|gains?|expand\w*|elevat\w*|pick.?up|rebound\w*|rose\b|risen\b|higher|increas\w*)\b"
QUICK_NEGATIVE = (
    r"\b(declin\w*|weak\w*|slow\w*|below\b|soft\b|modest\b|moderat\w*|concern\w*|risk\b|risks\b|deteriorat\w*|fell\b|fallen\b|decreas\w*|"
    r"contract\w*|restrain\w*)\b"
)
CONDITIONS = {
    "inflation": (
        r"\b(inflation|price (?:level|stability|target)|pce|cpi|deflation|inflationary|disinflation\w*|price pressure|2 percent (?:goal|target|"
        r"objective))\b"
    ),
    "employment": r"\b(employment|unemployment|labor market|payroll|job\b|hiring|labor force|workforce|workers?|maximum employment)\b",
    "economic_activity": r"\b(gdp|output gap|growth|spending|consumption|production|economic activity|economic conditions|recession|expansion|recovery)\b",
    "macro": r"\b(global|international|foreign|fiscal|government spending|deficit|debt|trade|geopolit\w*)\b",
    "financial_conditions": (
        r"\b(financial (?:condition|market|stability)|credit condition|interest rate spread|yield|equity market|stock market|bank|financial stress|"
        r"financial tighten|financial eas)\b"
    ),
}

# Openings, nouns and conjunctions that tie a sentence to the one before it; stock phrases.
DEPENDENT = [
    "therefore",
    "thus",
    "consequently",
    "as a result",
    "for example",
    "that ",
    "this is ",
    "this was ",
    "these are ",
    "these were ",
    "i think they",
    "i think those",
    "i think these",
    "i think that",
    "we think they",
    "we think those",
    "we think these",
    "we think that",
]
#: also, in conversation
CONVERSATIONAL = [
    "so ",
    "but ",
    "and ",
    "then ",
    "and then",
    "and so",
]
CONJUNCTIONS = r"\b(although|though|even though|while|whilst|whereas|because|since|as\b|when\b|if\b|unless|until|before|after|despite|in spite of)\b"
STOCK_PHRASES = [
    r"^\s*[A-Z][a-z]+.*?\(\d{4}\).*?(?:pp\.|vol\.|journal|review|quarterly)",
    r'^\s*"[^"]+,"\s*(speech|remarks|testimony|statement)',
    r"doi\.org",
    r"rey\s*\(\d{4}\)",
    "miranda.agrippino",
    r"^\s*ibid\.",
    r"^\s*op\.\s*cit\.",
    r"^\s*\d+\s*$",
    r"^\s*page \d+",
    r"^\s*\d+\s+see\s+",
    r"^\s*\*+\s",
    r"^\s*[ivxlcdm]+\.\s",
    r"^\s*\w+\.\s*$",
    r"^\s*(figure|table|chart|exhibit)\s+\w",
    r"^\s*(note|source|notes):\s",
    "for release on delivery",
    r"^\s*class i fomc",
    "authorized for public release",
    "restricted controlled",
    r"^\s*transcript of (chairman|the|vice)",
    r"^\s*statement regarding",
    r"^\s*monetary policy normalization\s*$",
    r"^\s*(mr\.|ms\.|mrs\.|dr\.)\s+[a-z]+\s*[:,]",
    r"^\s*present\s*:",
    r"^\s*voting\s+(for|against)",
    r"^\s*the vote was",
    r"^\s*(present|voting|absent|attended)",
    r"^\s*(mr\.|ms\.|mrs\.) [a-z]+ (noted|said|stated|added)",
    "voted as (?:an )?alternate member",
    r"[a-z\s]+@[a-z]+\.[a-z]+",
    r"[\w\s]+frb\.gov",
    "for media inquiries",
    r"^\s*implementation note",
    r"^\s*attendance",
    "attended (through|the discussion|opening|wednesday|tuesday)",
    "return to text",
    "secretary's note",
    r"^\s*the meeting adjourned",
    "board of governors.*voted unanimously to (lower|raise|approve)",
    r"jerome h\. powell, chair",
    "the fomc directs the desk to",
    "in taking this action, the board approved requests",
    "(this |the )?vote also encompassed approval by the board of governors",
    "_{3,}",
    r"secretary\s+\d+\.\s*$",
    r"^\s*footnote \d+ has been corrected",
    r"^\s*the elected members and alternate members",
    "by unanimous vote,",
    r"^\s*the guidelines for the conduct",
    r"^\s*the federal open market committee authorizes and directs",
    r"^\s*to buy or sell",
    r"^\s*to hold balances of",
    r"^\s*to purchase and sell the following foreign currencies",
    r"^\s*authorization for (domestic|foreign)",
    r"^\s*foreign currency directive",
    r"^\s*procedural instructions with respect to foreign currency",
    "reaffirmed january",
    r"^\s*in order to ensure the effective conduct of open market",
    r"^\s*the federal reserve bank of new york shall",
    r"^\s*the federal reserve bank of new york may reject",
    r"^\s*all (transactions|operations|federal reserve banks) (undertaken|shall)",
    r"^\s*the foreign currency subcommittee",
    r"^\s*meetings of the subcommittee",
    r"^\s*with the approval of the committee, to enter",
    r"^\s*to keep the secretary of the treasury",
    r"^\s*staff officers of the committee",
    "system operations in foreign currencies shall",
    r"^\s*undertake spot and forward",
    r"^\s*maintain reciprocal currency",
    r"^\s*to adjust system balances",
    r"^\s*to provide means for meeting system",
    r"^\s*system foreign currency operations shall",
    r"^\s*in close and continuous consultation",
    r"^\s*in cooperation, as appropriate",
    "notation vote",
    "it was agreed that the next meeting",
    "the other members of the subcommittee will include",
    "the role of the subcommittee will be to",
    "at the conclusion of the discussion, the committee voted to authorize",
    "the vote encompassed approval of the statement below",
    r"^\s*chairman,\s+[a-z]",
    r"^\s*i'm [a-z]+ [a-z]+ (from|with|of)",
    r"^\s*[a-z]+ [a-z]+[\s,]*(from|with|of|filing for)\s+(the\s+)?(wall street journal|financial times|reuters|associated press|bloomberg|cnbc|fox business|washington post|new york times|politico|axios|marketplace|american banker|marketwatch|bankrate|dow jones newswires|market news international|agence france.presse|nikkei|l\.a\.\s*times|los angeles times|npr)",
    r"^\s*[a-z]+ [a-z]+,\s+(the\s+)?(wall street journal|financial times|reuters|associated press|bloomberg|cnbc|fox business|washington post|new york times|politico|axios|marketplace|american banker|marketwatch|bankrate|dow jones newswires|market news international|agence france.presse|nikkei|l\.a\.\s*times|los angeles times|npr)\.",
    r"^\s*thanks\s+(for being here|very much|mr\.|mr\s+chair)",
    r"^\s*thank you[\s,\.!]*$",
    r"^\s*thank you,?\s*(for taking|for being|very much|mr\.|madam chair)",
    r"^\s*i('m| am) happy to take your questions",
    r"^\s*i('ll| will) (then )?be glad to take your questions",
    r"^\s*hi[\s,\.!]",
    r"^\s*let me stop there",
    "a table showing the projections has been distributed",
    r"^\s*i turn now to (the committee\'s|our)",
    r"^\s*i would now like to turn",
    r"^\s*i would be pleased to take your questions",
    r"^\s*good (morning|afternoon|evening)[,\.]",
    r"^\s*welcome[\.,]",
    r"^\s*welcome to the federal reserve",
    r"^\s*i am sorry that",
    r"^\s*we'll go to \w+ for the (last|next) question",
    r"^\s*hey there[--]",
    r"^\s*--",
    r"chair powell\.?\s*$",
    r"chair yellen\.?\s*$",
    "for the last question",
    r"board of governors of the federal reserve system\s+20th street",
    "return to text accessible version",
    r"^\s*\.\s*$",
]
DEMONSTRATIVE = (
    r"\b(?:this|that|these|those|such)\s+(outcome|goal|objective|development|progress|condition|measure|action|policy|purchase|assessment|view|"
    "stance|trend|event|effect|forecast|projection|risk|imbalance|strain|factor|aspect|area|issue|concern|pressure|indicator|approach|dynamic|"
    "tension|challenge|uncertainty|decision|situation|circumstance|environment|signal|pattern|finding|feature|consideration|dynamic|shift|change|"
    r"move|step|path|framework|backdrop|context|regime|episode|period|phase|cycle)s?\b"
)
