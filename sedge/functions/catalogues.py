"""Built-in catalogues of contract facts. They are data: pass them to ``extract_facts``, or add rows of your own."""

from __future__ import annotations

from sedge.operators.facts import FactRule

MONEY = r"\$ ?([0-9][0-9,]*(?:\.[0-9]{2})?)"
DATE = r"([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|[0-9]{4}-[0-9]{2}-[0-9]{2})"
SPAN = r"([0-9]+ (?:business )?(?:day|month|year)s?)"
PARTY = r"([A-Z&][A-Za-z0-9&.'-]*(?:,? [A-Z&][A-Za-z0-9&.'-]*){0,7})"

RENT = (
    FactRule("rent_amount", rf"(?i:(?:base|monthly|minimum|annual) rent)[^$\n]{{0,80}}{MONEY}", 1, 0.9),
    FactRule("rent_amount", rf"(?i:rent (?:is|of|shall be))[^$\n]{{0,40}}{MONEY}", 1, 0.8),
    FactRule("rent_frequency", r"(?i)rent[^.\n]{0,120}?\b(per month|monthly|per year|annually|per annum|quarterly)\b", 1, 0.8),
    FactRule("rent_per_area", r"(?i)(per (?:rentable )?square (?:foot|feet|metre|meter))", 1, 0.7),
    FactRule("escalation", r"(?i)increas\w*[^.%\n]{0,80}?([0-9]+(?:\.[0-9]+)?) ?%", 1, 0.8),
    FactRule("escalation_index", r"(?i)\b(consumer price index|cpi)\b", 1, 0.7),
    FactRule("free_rent", r"(?i)([0-9]+) months?[^.\n]{0,30}(?:free|abated) rent", 1, 0.8),
)
PERCENTAGE_RENT = (
    FactRule("percentage", r"(?i)percentage rent[^.%\n]{0,120}?([0-9]+(?:\.[0-9]+)?) ?%", 1, 0.85),
    FactRule("breakpoint", rf"(?i:gross sales)[^$\n]{{0,80}}{MONEY}", 1, 0.8),
    FactRule("exclusions", r"(?i)gross sales (?:shall )?exclud\w+ ([^.\n]+)", 1, 0.7),
)
SHARED_COSTS = (
    FactRule("structure", r"(?i)\b(triple net|nnn|modified gross|full service|pro rata share)\b", 1, 0.8),
    FactRule("estimate", rf"(?i:common area)[^$\n]{{0,100}}{MONEY}", 1, 0.8),
    FactRule("cap", r"(?i)(?:cap|not exceed)\w*[^.%\n]{0,60}?([0-9]+(?:\.[0-9]+)?) ?%", 1, 0.8),
    FactRule("admin_fee", r"(?i)administrative fee[^.%\n]{0,40}?([0-9]+(?:\.[0-9]+)?) ?%", 1, 0.8),
    FactRule("reconciliation", r"(?i)reconcil\w+[^.\n]{0,40}?\b(annual\w*|quarterly|monthly)\b", 1, 0.7),
)
CRITICAL_DATES = (
    FactRule("start_date", rf"(?i:commenc\w*|start date|beginning)[^.\n]{{0,40}}?{DATE}", 1, 0.9),
    FactRule("end_date", rf"(?i:expir\w*|end date|ending|terminat\w*)[^.\n]{{0,40}}?{DATE}", 1, 0.9),
    FactRule("option_notice", rf"(?i:renew\w*|option|extend)[^.\n]{{0,80}}?{SPAN}[^.\n]{{0,20}}notice", 1, 0.8),
)
NOTICE = (
    FactRule("default_notice", rf"(?i:default)[^.\n]{{0,80}}?{SPAN}[^.\n]{{0,30}}notice", 1, 0.85),
    FactRule("cure_period", rf"(?i:cure)[^.\n]{{0,60}}?{SPAN}", 1, 0.85),
    FactRule("notice", rf"{SPAN}[^.\n]{{0,20}}(?i:notice)", 1, 0.7),
)
CONDITIONS = (
    FactRule("condition", r"(?i)\bif ([^.;\n]{3,200}?),? then\b", 1, 0.8),
    FactRule("consequence", r"(?i)\bif [^.;\n]{3,200}?,? then ([^.;\n]+)", 1, 0.8),
    FactRule("trigger", r"(?i)\b(provided that|subject to|contingent (?:up)?on|in the event|unless|conditioned (?:up)?on)\b", 1, 0.6),
    FactRule("co_tenancy", r"(?i)\b(co-?tenancy)\b", 1, 0.85),
    FactRule("co_tenancy_opening", r"(?i)(?:open(?:s|ing)?|commence) only (?:if|when|once) ([^.;\n]{3,120})", 1, 0.6),
    FactRule("co_tenancy_remedy", r"(?i)co-?tenancy[^.\n]{0,120}?\b(rent (?:abates|is halved|is reduced)|may terminate|applies unless waived|alternative rent)", 1, 0.9),
)
OPTIONS = (
    FactRule("renewal_options", r"(?i)\b(one|two|three|four|five|[1-9])(?: \([0-9]\))? (?:additional |successive )?(?:renewal )?options?\b", 1, 0.8),
    FactRule("option_term", rf"(?i:option)[^.\n]{{0,80}}?{SPAN}", 1, 0.8),
    FactRule("renewal_rent", r"(?i)(?:renewal|option)[^.\n]{0,80}? rent (?:is|at|shall be|equals) (?:the )?(fair market (?:value|rent)|[0-9]+ ?% of [a-z ]{3,40}|same rent|\$ ?[0-9][0-9,]*)", 1, 0.8),
    FactRule("first_refusal", r"(?i)\b(right of first refusal)\b", 1, 0.9),
    FactRule("first_offer", r"(?i)\b(right of first offer)\b", 1, 0.9),
    FactRule("expansion", r"(?i)\b(expansion (?:right|option))\b", 1, 0.8),
)
PARTIES = (
    FactRule("landlord", rf"{PARTY},? ?\((?i:the )?[\"“]?(?i:landlord|lessor)[\"”]?\)", 1, 0.85, words=("landlord)", "landlord\")", "landlord”)", "lessor)", "lessor\")", "lessor”)"), in_line=True),
    FactRule("landlord", rf"(?i:landlord|lessor): ?{PARTY}(?:\n|$)", 1, 0.7, words=("landlord:", "lessor:"), in_line=True, line_end=True),
    FactRule("tenant", rf"{PARTY},? ?\((?i:the )?[\"“]?(?i:tenant|lessee)[\"”]?\)", 1, 0.85, words=("tenant)", "tenant\")", "tenant”)", "lessee)", "lessee\")", "lessee”)"), in_line=True),
    FactRule("tenant", rf"(?i:tenant|lessee): ?{PARTY}(?:\n|$)", 1, 0.7, words=("tenant:", "lessee:"), in_line=True, line_end=True),
    FactRule("premises", r"(?i:premises|located at|property at):? (?:known as )?([0-9]+ [A-Z][A-Za-z0-9 .,-]{3,80})", 1, 0.7, words=("premises", "located at", "property at"), in_line=True),
    FactRule("term", rf"(?i:term (?:is|of|shall be))[^.\n]{{0,30}}?{SPAN}", 1, 0.85, words=("term is", "term of", "term shall be"), in_line=True),
    FactRule("deposit", rf"(?i:security deposit)[^$\n]{{0,60}}{MONEY}", 1, 0.85, words=("security deposit",), in_line=True),
    FactRule("use", r"(?i)(?:used? (?:solely |only )?(?:as|for)) ([^.\n]{3,80})", 1, 0.7, words=("use as", "use for", "used as", "used for", "use solely", "use only", "used solely", "used only"), in_line=True),
    FactRule("landlord_address", r"(?i:landlord|lessor)(?i:'s)? (?i:address|notices?)(?i: is| are sent to)?:? ?([0-9]+ [A-Z][A-Za-z0-9 .,-]{3,80})", 1, 0.7, words=("landlord address", "landlord notice", "landlord's address", "landlord's notice", "lessor address", "lessor notice", "lessor's address", "lessor's notice"), in_line=True),
    FactRule("tenant_address", r"(?i:tenant|lessee)(?i:'s)? (?i:address|notices?)(?i: is| are sent to)?:? ?([0-9]+ [A-Z][A-Za-z0-9 .,-]{3,80})", 1, 0.7, words=("tenant address", "tenant notice", "tenant's address", "tenant's notice", "lessee address", "lessee notice", "lessee's address", "lessee's notice"), in_line=True),
    FactRule("guarantor", rf"(?i:guarantors?|guaranteed by):? ?{PARTY}", 1, 0.75, words=("guarantor", "guaranteed by"), in_line=True),
    FactRule("broker", rf"(?i:brokers?|agent):? ?{PARTY}", 1, 0.6, words=("broker", "agent"), in_line=True),
    FactRule("occupants", r"(?i)\b([0-9]+|one|two|three|four|five|six) (?:adult )?(?:occupants?|persons|residents)\b", 1, 0.7, words=("occupant", "persons", "resident"), in_line=True),
    FactRule("unit", r"(?i)\b(?:unit|suite|apartment|apt\.?) (?:no\.? )?([0-9]+[A-Z]?)\b", 1, 0.75, words=("unit ", "suite ", "apartment ", "apt"), in_line=True),
    FactRule("floor", r"(?i)\b((?:ground|first|second|third|fourth|fifth|[0-9]+(?:st|nd|rd|th)) floor)\b", 1, 0.7, words=("floor",), in_line=True),
    FactRule("area", r"(?i)\b([0-9][0-9,]*(?:\.[0-9]+)?) ?(?:rentable |usable )?(?:square feet|sq\.? ?ft|square met(?:er|re)s?)", 1, 0.8, words=("square feet", "square met", "sqft", "sq ft", "sq.ft", "sq. ft"), in_line=True),
    FactRule("bedrooms", r"(?i)\b([0-9]+|one|two|three|four|five)[- ]bedrooms?\b", 1, 0.75, words=("bedroom",), in_line=True),
    FactRule("parking", r"(?i)\b([0-9]+|one|two|three|four|five) (?:reserved |covered )?parking (?:spaces?|stalls?|bays?)", 1, 0.8, words=("parking",), in_line=True),
    FactRule("storage", r"(?i)\b(storage (?:unit|room|space|locker))\b", 1, 0.6, words=("storage ",), in_line=True),
    FactRule("furnished", r"(?i)\b((?:un|partly |fully )?furnished)\b", 1, 0.6, words=("furnished",), in_line=True),
    FactRule("start_of_term", rf"(?i:commenc\w*|begins?|starts?) (?i:on )?{DATE}", 1, 0.8, words=("commenc", "begin", "start"), in_line=True),
    FactRule("end_of_term", rf"(?i:expir\w*|ends?) (?i:on )?{DATE}", 1, 0.8, words=("expir", "end ", "ends "), in_line=True),
    FactRule("month_to_month", r"(?i)\b(month[- ]to[- ]month)\b", 1, 0.8, words=("month-to-month", "month-to month", "month to-month", "month to month"), in_line=True),
    FactRule("holdover", r"(?i)\bhold(?:ing)?[- ]?over\b[^.\n]{0,80}?([0-9]+) ?%", 1, 0.75, words=("holdover", "hold-over", "hold over", "holdingover", "holding-over", "holding over"), in_line=True),
    FactRule("rent_due", r"(?i)\b(?:due|payable) (?:on|by) the ([0-9]{1,2}(?:st|nd|rd|th)?|first|last) (?:day )?of (?:each|every|the) month", 1, 0.8, words=("due on the", "due by the", "payable on the", "payable by the"), in_line=True),
    FactRule("late_fee", rf"(?i:late (?:fee|charge))[^$\n]{{0,40}}{MONEY}", 1, 0.8, words=("late fee", "late charge"), in_line=True),
    FactRule("late_fee_percent", r"(?i)late (?:fee|charge)[^.%\n]{0,40}?([0-9]+(?:\.[0-9]+)?) ?%", 1, 0.75, words=("late fee", "late charge"), in_line=True),
    FactRule("grace_period", r"(?i)grace period[^.\n]{0,20}?([0-9]+ days?)", 1, 0.75, words=("grace period",), in_line=True),
    FactRule("returned_payment", rf"(?i:returned|dishono(?:u)?red) (?i:check|cheque|payment)[^$\n]{{0,40}}{MONEY}", 1, 0.7, words=("returned check", "returned cheque", "returned payment", "dishonored check", "dishonored cheque", "dishonored payment", "dishonoured check", "dishonoured cheque", "dishonoured payment"), in_line=True),
    FactRule("prorated_rent", rf"(?i:prorated)[^$\n]{{0,40}}{MONEY}", 1, 0.7, words=("prorated",), in_line=True),
    FactRule("last_month", rf"(?i:last month'?s? rent)[^$\n]{{0,40}}{MONEY}", 1, 0.7, words=("last month",), in_line=True),
    FactRule("deposit_return", r"(?i)deposit[^.\n]{0,80}?(?:returned|refunded) within ([0-9]+ days)", 1, 0.75, words=("returned within", "refunded within"), in_line=True),
    FactRule("cleaning_fee", rf"(?i:cleaning (?:fee|charge))[^$\n]{{0,40}}{MONEY}", 1, 0.7, words=("cleaning fee", "cleaning charge"), in_line=True),
    FactRule("pets", r"(?i)\b(no pets(?: are)?(?: allowed)?|pets? (?:is|are) (?:not )?(?:allowed|permitted))\b", 1, 0.75, words=("pet",), in_line=True),
    FactRule("pet_fee", rf"(?i:pet (?:fee|deposit|rent))[^$\n]{{0,40}}{MONEY}", 1, 0.75, words=("pet fee", "pet deposit", "pet rent"), in_line=True),
    FactRule("utilities", r"(?i)\b(?:tenant|lessee|landlord|lessor) (?:pays?|shall pay|is responsible) for ((?:water|gas|electric\w*|heat\w*|internet|trash)(?:(?:, | and |, and )(?:water|gas|electric\w*|heat\w*|internet|trash|sewer))*)", 1, 0.75, words=("pay for", "pays for", "responsible for"), in_line=True),
    FactRule("smoking", r"(?i)\b(no smoking|smoking is (?:not )?(?:allowed|permitted|prohibited))\b", 1, 0.7, words=("smoking",), in_line=True),
    FactRule("subletting", r"(?i)\b((?:no )?sublet\w* (?:is|are)? ?(?:not )?(?:allowed|permitted|prohibited))\b", 1, 0.6, words=("sublet",), in_line=True),
    FactRule("entry_notice", r"(?i)\b(?:enter|entry|access)\b[^.\n]{0,60}?([0-9]+ (?:hours?|days?))", 1, 0.7, words=("enter", "entry", "access"), in_line=True),
    FactRule("insurance_minimum", rf"(?i:liability insurance|renter'?s insurance)[^$\n]{{0,60}}{MONEY}", 1, 0.7, words=("liability insurance", "renters insurance", "renter's insurance"), in_line=True),
    FactRule("governing_law", r"(?i:laws? of) (?i:the )?(?i:state of )?([A-Z][a-z]+(?: [A-Z][a-z]+)?)", 1, 0.7, words=("law of", "laws of"), in_line=True),
)

#: Patterns of two groups: pairs that belong together.
PAIRS = {
    "percentage_breaks": r"([0-9]+(?:\.[0-9]+)?) ?% of (?i:gross sales) (?i:over|above|exceeding|in excess of) \$ ?([0-9][0-9,]*(?:\.[0-9]{2})?)",
    "conditions": r"(?i)\bif ([^.;\n]{3,200}?),? then ([^.;\n]+)",
    "notice_periods": r"(?i)\b([0-9]+) (business days?|days?|months?|years?)[^.\n]{0,30}notice",
    "escalations": r"(?i)increas\w*[^.%\n]{0,80}?([0-9]+(?:\.[0-9]+)?) ?%[^.\n]{0,40}?(annually|per year|every year|each year|monthly|quarterly)",
}

#: Words of which every match of a pair's pattern holds one in its line.
PAIR_WORDS = {"percentage_breaks": ("% of gross sales",), "conditions": (" then ",), "notice_periods": ("notice",), "escalations": ("increas",)}

#: Risk tags that texts may carry: (tag, level, pattern).
RISK_TAGS = (
    ("no_notice", "high", r"(?i)without (?:any |prior )?(?:written )?notice"),
    ("sole_discretion", "medium", r"(?i)\b(?:sole|absolute|unfettered) discretion\b"),
    ("unlimited_liability", "high", r"(?i)\b(?:unlimited|uncapped) (?:liability|indemnity|guaranty)\b"),
    ("waiver", "medium", r"(?i)\bwaives? (?:all|any) (?:rights?|claims?|defen[cs]es?)\b"),
    ("acceleration", "high", r"(?i)\b(?:accelerat\w+ (?:all |the )?rent|rent[^.\n]{0,40}immediately due)\b"),
    ("relocation", "medium", r"(?i)\brelocat\w+[^.\n]{0,40}\b(?:tenant|lessee|premises)\b"),
    ("automatic_renewal", "medium", r"(?i)\b(?:automatic(?:ally)?) (?:renew\w*|extend\w*)\b"),
    ("as_is", "low", r"(?i)\bas[- ]is\b"),
    ("personal_guaranty", "high", r"(?i)\bpersonal(?:ly)? guarant\w+"),
    ("penalty", "medium", r"(?i)\b(?:late fee|penalty|liquidated damages)\b"),
    ("placeholder", "medium", r"(?i)\[(?:insert|tbd|amount|date|name)[^\]\n]{0,40}\]|_{4,}|\bTBD\b"),
)


#: Sections of contracts for ``segment.pattern_sections``: group and pattern of a line in lower case that begins it; the first that fits counts. Those of a type are in SECTIONS_OF.
_OPENS = r"^(?:(?:article|section|clause) +)?(?:[0-9ivxl]+[.):]?[0-9.]* *)?(?:-|–)? *"
SECTIONS = tuple((group, rf"{_OPENS}(?:{words})\b") for group, words in (
    ("parties", "parties|between|landlord|lessor|tenant|lessee"), ("premises", "(?:leased |demised )?premises|property|location"), ("term", "(?:the |lease )?term|commencement|duration"), ("rent", "(?:base |minimum |the base )?rent|payments?"),
    ("deposit", "(?:the )?security deposit|bond"), ("use", "(?:permitted )?use|purpose"), ("maintenance", "maintenance|repairs?|upkeep"), ("utilities", "utilities|services"), ("insurance", "insurance|indemni(?:ty|fication)|liability"),
    ("assignment", "assignment|sublet(?:ting)?|transfers?"), ("default", "(?:on |events? of )?default|remed(?:y|ies)|breach"), ("termination", "termination|surrender|early end"), ("general", "general|miscellaneous|notices?|signatures?"),
))
SECTIONS_OF = {kind: tuple((group, rf"{_OPENS}(?:{words})\b") for group, words in rows) for kind, rows in {
    "retail": (("co_tenancy", "co-?tenancy"), ("percentage_rent", "percentage rent|gross sales"), ("hours", "(?:opening|operating) hours")),
    "office": (("expenses", "operating expenses|shared costs"), ("improvements", "(?:tenant )?improvements|fit-?out"), ("parking", "parking")),
    "industrial": (("environment", "environmental|hazardous"), ("equipment", "equipment|loading")),
}.items()}

#: Types of tables for ``texttables.type_score``: name, words of headers, words of the first rows.
TABLE_TYPES = (
    ("rent schedule", ("rent", "month", "year", "period"), ("$", "year", "month")), ("cost allocation", ("share", "cost", "expense", "percent"), ("%", "tax", "insurance")),
    ("tenant roster", ("tenant", "unit", "area", "suite"), ("vacant", "sq", "llc")), ("dates", ("date", "event", "deadline", "notice"), ("20", "days", "expir")), ("parties", ("name", "party", "address", "role"), ("landlord", "tenant", "street")),
)

#: Fields of a response that is plain text, for ``facts.parse_key_values``: a later pattern of a field overwrites an earlier one.
KEY_VALUES = tuple((field, rf"(?im)^[ \t>*-]*[\"']?(?:{names})[\"']?[ \t]*[:=][ \t]*([^\n]+)$") for field, names in (
    ("tenant", "tenant|lessee"), ("landlord", "landlord|lessor|owner"), ("premises", "premises|address|property"), ("term", "term|lease term|duration"), ("start_date", "start|start date|commencement"),
    ("end_date", "end|end date|expir(?:y|ation)"), ("rent", "rent"), ("rent", "base rent|monthly rent"), ("deposit", "(?:security )?deposit"), ("use", "(?:permitted )?use"), ("renewal", "renewals?|options?"), ("notes", "notes?|remarks?"),
))

#: First words of a document's type, for ``facts.overview``.
DOCUMENT_TYPES = (("AMENDMENT", ("amendment", "addendum")), ("EXHIBIT", ("exhibit", "annex")), ("LEASE", ("lease", "tenancy")), ("AGREEMENT", ("agreement", "contract")))

#: Phrases that tie a clause to another, for ``graph.reference_edges``: pattern with the number as its group, edge type, as phrases of contracts go.
REFERENCE_PHRASES = tuple((rf"(?i)\b(?:{words})\s+(?:section|article|clause|paragraph)\s+([0-9]+(?:\.[0-9]+)*)", kind) for words, kind in (
    ("as defined in|pursuant to|subject to|in accordance with", "cross_reference"), ("as (?:set forth|provided|described) in", "cross_reference"), ("notwithstanding|except as provided in|modified by", "modifies"),
    ("contingent upon|dependent on|requires compliance with", "depends_on"), ("incorporating|including by reference", "incorporates"), ("subject to(?: the terms of)?", "subject_to"),
))

#: Headings of contracts for ``segment.headings``: pattern, level. A rule reads a line, or a line with the next one (``segment.line_windows``).
HEADINGS = (
    (r"^(?:ARTICLE|Article) +[IVXLCDM]+\b[ .:-]*[A-Za-z][^\n]{0,80}$", 1), (r"^(?:ARTICLE|Article) +[0-9]+\b[ .:-]*[A-Za-z][^\n]{0,80}$", 1), (r"^(?:ARTICLE|Article) +(?:[IVXLCDM]+|[0-9]+)[.:]?\n[^\n]{3,80}$", 1),
    (r"^(?:SECTION|Section) +[0-9]+(?:\.[0-9]+)*\b[^\n]{0,80}$", 2), (r"^[0-9]+\.[0-9]+\.? +[A-Z][^\n]{2,80}$", 2), (r"^(?!ARTICLE|SECTION)[A-Z][A-Z &,'-]{9,80}$", 2),
    (r"^[0-9]+\.[0-9]+ ?\([a-z]\)[^\n]{0,80}$", 3), (r"^\([a-z]\) +[A-Z][^\n]{2,80}$", 3),
)

#: Extractor factory: name -> catalogue.
CATALOGUES = {
    "rent": RENT, "percentage_rent": PERCENTAGE_RENT, "shared_costs": SHARED_COSTS, "critical_dates": CRITICAL_DATES,
    "notice": NOTICE, "conditions": CONDITIONS, "options": OPTIONS, "parties": PARTIES,
}
