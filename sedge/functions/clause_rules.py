"""Built-in risk rules of clauses, by contract type, and of whole documents.

A rule is put together from word lists: ``together`` asks for a word of each list in one sentence, in any order. So a rule reads as the
statement it looks for, and a list is extended in one place. Rules read ``clause_text``: the clause's key as the first line, then its text, in lower case.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sedge.functions.rules import Rule

#: What may stand between two words of one sentence.
_WITHIN = r"[^.;\n]*?"

WORDS = {
    "transfer": (r"assign(?:s|ed|ing|ment|ments)?", r"sub-?let(?:s|ting)?", r"sub-?leas(?:e|es|ed|ing)", r"transfer(?:s|red|ring)?", "hand over"),
    "unasked": (r"without (?:\w+(?:'s)? ){0,4}(?:consent|approval|permission)", "freely", "at will", r"no (?:consent|approval|permission) (?:is |being )?(?:needed|required|necessary)"),
    "barred": ("shall not", "must not", "may not", "cannot", "is not allowed", r"prohibit(?:s|ed|ion)?", "forbidden", r"restrict(?:s|ed|ions?)?"),
    "agree": (r"consent(?:s|ed)?", r"approv(?:e|es|ed|al)", "permission"),
    "fair": (r"(?:un)?reasonabl[ey]", r"arbitrar(?:y|ily)", "good faith", "capriciously"),
    "end": (r"terminat(?:e|es|ed|ing|ion)", r"cancel(?:s|led|lation)?", r"end (?:the|this) (?:lease|agreement|tenancy)"),
    "chance": ("early", "right to", "entitled to", "may", "at any time"),
    "span": (r"[0-9]+\)? (?:\w+ )?(?:days?|weeks?|months?|years?)", r"(?:ten|fifteen|twenty|thirty|sixty|ninety) days"),
    "notice": (r"noti(?:ce|ces|fy|fies|fied|fication)",),
    "begin": (r"commenc(?:e|es|ing|ement)", r"start(?:s|ing)? date", r"begin(?:s|ning)?"),
    "open": ("to be determined", "to be agreed", r"(?:not|never) (?:yet )?(?:been )?(?:determined|fixed|set|agreed)", r"(?:will|shall) be (?:determined|fixed|agreed)", r"\btbd\b"),
    "raise": (r"increas(?:e|es|ed|ing)", r"escalat(?:e|es|ed|ing|ion|ions|or)", r"adjust(?:s|ed|ment|ments)?", r"ris(?:e|es|ing)"),
    "amount": (r"[0-9] ?(?:%|percent|per cent)", r"\$ ?[0-9]", r"[0-9] dollars"),
    "percentage": (r"[0-9] ?(?:%|percent|per cent)",),
    "index": ("consumer prices?", r"price ind(?:ex|ices)", r"\bcpi\b", "cost of living"),
    "limit": (r"\bcap(?:s|ped)?\b", r"ceilings?", r"maxim(?:um|a|al)", r"(?:not|never|no more than|may not) (?:to )?exceed", "no more than", "at most"),
    "cover": (r"coverages?", r"cover(?:s|ed)?\b", r"polic(?:y|ies)", r"limits?\b", r"amounts?\b", r"insured"),
    "subrogation": ("subrogation", r"subrogated?\b"),
    "both": ("mutual(?:ly)?", "both parties", "each party", r"landlord and (?:the )?tenant", "either party"),
    "waive": (r"waiv(?:e|es|ed|er|ers|ing)", r"releas(?:e|es|ed)"),
    "narrowly": ("only", "solely", "exclusively", "for no other purpose"),
    "use": (r"\buse[ds]?\b", r"\busing\b", "purposes?", r"operat(?:e|es|ed|ion)"),
    "widely": (r"(?:similar|other|related|additional|ancillary|lawful) (?:\w+ )?(?:uses?|purposes?|activit(?:y|ies))",),
    "cotenancy": (r"co-?tenanc(?:y|ies)", "co_tenancy"),
    "remedy": (r"remed(?:y|ies)", r"terminat(?:e|es|ion)", r"abat(?:e|es|ed|ement)", r"reduc(?:e|es|ed|tion)", "half rent"),
    "percentage rent": (r"percentage[ _]rent", r"rent on (?:gross )?sales"),
    "hours": (r"hours?\b",),
    "centre": (r"shopping (?:cent(?:er|re)|park)s?", r"\bmalls?\b", r"\bcent(?:er|re)\b"),
    "must": ("must", "shall", r"require(?:s|d)", r"oblig(?:ed|ated|es)", "is bound to"),
    "shop": (r"\bretail(?:er|ers|ing)?\b", r"\bshops?\b", r"\bstores?\b", r"shopping (?:cent(?:er|re)|park)s?", r"\bmalls?\b"),
    "exclusive": (r"exclusiv(?:e|es|ity)",),
    "tenant": ("tenants?", "lessees?"),
    "landlord": ("landlords?", "lessors?", "owner"),
    "expenses": (r"operating[ _](?:expenses?|costs?)", r"\bopex\b", r"expense", "running costs"),
    "check": (r"audit(?:s|ed|ing)?", r"inspect(?:s|ed|ion)?", r"review(?:s|ed)?", r"examin(?:e|es|ed|ation)"),
    "accounts": (r"\bbooks?\b", r"\brecords?\b", r"\baccounts\b", r"\bledgers?\b"),
    "area": (r"square[ _](?:feet|foot|metres?|meters?)", r"\bsq ?ft\b", r"^[^\n]*(?:area|premises)"),
    "standard": (r"\bboma\b", r"\bansi\b", r"\bipms\b", r"(?:measurement|measuring) (?:standard|method)"),
    "allowance": (r"improvement[ _]allowance", r"^[^\n]*(?:allowance|build-?out|improvement)", "fit-?out contribution"),
    "per area": (r"per square (?:foot|metre|meter)",),
    "answer": (r"responsib(?:le|ility)", r"liab(?:le|ility)", r"remediat(?:e|es|ion)", r"clean(?:s|ed|ing)?[ -]?up", r"\bclean\b", r"compl(?:y|ies|iance)", "bears? the cost"),
    "earlier": (r"pre-?exist(?:s|ed|ing)?", r"\bprior\b", r"\bexisting\b", "earlier", r"before (?:the )?(?:lease|term|commencement)"),
    "nature": (r"environment(?:al)?", "contaminat(?:ed|ion)", r"\bspills?\b"),
    "hazard": (r"hazardous", r"toxic (?:waste|substances?|materials?)", "hazmat"),
    "disclose": (r"represent(?:s|ed|ations?)?", r"warrant(?:s|ed|y|ies)?", r"disclos(?:e|es|ed|ure)"),
    "indemnify": (r"indemni(?:fy|fies|fied|ty)", r"h[eo]ld(?:s)? (?:\w+ ){0,3}harmless"),
    "except": (r"except(?:ing|ion|ions)?", "excluding", "other than", "save for"),
    "access": ("accessibility", "disabilities act", r"\bada\b", r"barrier-free"),
    "building": (r"\bpremises\b", r"\bbuilding\b", r"\bexisting\b", r"\bcurrent(?:ly)?\b"),
    "repair": (r"repair(?:s|ed|ing)?", r"maintain(?:s|ed)?", r"maintenance"),
    "structure": (r"structur(?:e|es|al)", r"\broof\b", r"foundations?"),
    "property insurance": ("property insurance", r"insur(?:e|es|ance)(?: \w+){0,3} (?:the )?(?:building|property)"),
    "accelerate": (r"accelerat(?:e|es|ed|ion)", r"(?:at once|immediately) due"),
    "rent": (r"\brents?\b", r"rental payments?"),
}

#: Of the lists that rules ask for: what every word of a list begins with or holds. ``needs`` are made of these, so a word that is new in WORDS must hold one here.
STEMS = {
    "transfer": ("assign", "sublet", "sub-let", "subleas", "sub-leas", "transfer", "hand over"),
    "unasked": ("without ", "freely", "at will", "no consent", "no approval", "no permission"),
    "barred": ("shall not", "must not", "may not", "cannot", "is not allowed", "prohibit", "forbidden", "restrict"),
    "end": ("terminat", "cancel", "end the ", "end this "),
    "chance": ("early", "right to", "entitled to", "may", "at any time"),
    "begin": ("commenc", "start", "begin"),
    "open": ("to be agreed", "determined", "fixed", " set", "agreed", "tbd"),
    "raise": ("increas", "escalat", "adjust", "rise", "rising"),
    "index": ("consumer price", "price ind", "cpi", "cost of living"),
    "limit": ("cap", "ceiling", "maxim", "exceed", "no more than", "at most"),
    "cover": ("cover", "polic", "limit", "amount", "insured"),
    "subrogation": ("subrogat",),
    "narrowly": ("only", "solely", "exclusively", "for no other purpose"),
    "use": ("use", "using", "purpose", "operat"),
    "widely": ("similar ", "other ", "related ", "additional ", "ancillary ", "lawful "),
    "cotenancy": ("cotenanc", "co-tenanc", "co_tenancy"),
    "percentage rent": ("percentage rent", "percentage_rent", "rent on "),
    "hours": ("hour",),
    "centre": ("shopping ", "mall", "center", "centre"),
    "must": ("must", "shall", "require", "oblig", "is bound to"),
    "shop": ("retail", "shop", "store", "mall"),
    "exclusive": ("exclusiv",),
    "tenant": ("tenant", "lessee"),
    "landlord": ("landlord", "lessor", "owner"),
    "expenses": ("operating cost", "operating_cost", "opex", "expense", "running costs"),
    "area": ("square", "sqft", "sq ft", "area", "premises"),
    "allowance": ("allowance", "buildout", "build-out", "improvement", "fitout contribution", "fit-out contribution"),
    "answer": ("responsib", "liab", "remediat", "clean", "compl", "bear the cost", "bears the cost"),
    "earlier": ("exist", "prior", "earlier", "before "),
    "nature": ("environment", "contaminat", "spill"),
    "hazard": ("hazardous", "toxic ", "hazmat"),
    "indemnify": ("indemni", "harmless"),
    "access": ("accessibility", "disabilities act", "ada", "barrier-free"),
    "building": ("premises", "building", "exist", "current"),
}


def any_of(name: str) -> str:
    return f"(?:{'|'.join(WORDS[name])})"


def together(*names: str) -> str:
    """A word of each list within one sentence, in any order."""
    return "|".join(_WITHIN.join(any_of(n) for n in order) for order in permutations(names))


def stems(*names: str) -> tuple[tuple[str, ...], ...]:
    """``needs`` of a rule that asks for a word of each list."""
    return tuple(STEMS[n] for n in names)


def key_has(*parts: str) -> str:
    """The clause's key, its first line, holds one of ``parts``."""
    return rf"^[^\n]*(?:{'|'.join(parts)})"


def clause_text(key: Column, text: Column) -> Column:
    return F.lower(F.concat(F.coalesce(key, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))


#: Parts of keys.
_KEYS = ("assign", "sublet", "transfer"), ("term", "commencement"), ("rent", "payment"), ("insurance", "liability", "indemnity"), ("use",)
_TRANSFER, _TERM, _RENT, _COVER, _USE = (key_has(*parts) for parts in _KEYS)
_TRANSFER_KEY, _TERM_KEY, _RENT_KEY, _COVER_KEY, _USE_KEY = _KEYS

#: Risk rules of clauses by contract type; those of "all" hold for every type.
CLAUSE_RISKS = {
    "all": (
        Rule("transfer", together("unasked", "transfer"), name="broad_assignment_rights", level="high", gate=_TRANSFER, needs=(_TRANSFER_KEY, *stems("unasked", "transfer")), message="the lease can be passed on without consent"),
        Rule("transfer", together("barred", "transfer"), name="arbitrary_consent_standard", level="medium", gate=_TRANSFER, unless=together("agree", "fair"), needs=(_TRANSFER_KEY, *stems("barred", "transfer")), message="a transfer is barred and nothing says how consent is given"),
        Rule("term", together("chance", "end"), name="unclear_termination_notice", level="high", gate=_TERM, unless=together("notice", "span"), needs=(_TERM_KEY, *stems("chance", "end")), message="the contract can be ended without a period of notice"),
        Rule("term", together("begin", "open"), name="uncertain_commencement", level="medium", gate=_TERM, needs=(_TERM_KEY, *stems("begin", "open")), message="the beginning is left open"),
        Rule("rent", any_of("raise"), name="undefined_escalation", level="high", gate=_RENT, unless=any_of("amount"), needs=(_RENT_KEY, *stems("raise")), message="a rise without an amount"),
        Rule("rent", any_of("index"), name="uncapped_cpi", level="medium", gate=_RENT, unless=any_of("limit"), needs=(_RENT_KEY, *stems("index")), spared=stems("limit"), message="an index without a limit"),
        Rule("insurance", r"(?s)^[^\n]*\n.{0,199}$", name="incomplete_insurance", level="high", gate=_COVER, needs=(_COVER_KEY,), message="too short to describe the cover"),
        Rule("insurance", r"^", name="insurance_without_limits", level="high", gate=_COVER, unless=rf"(?s)\n.*{any_of('cover')}", needs=(_COVER_KEY,), spared=stems("cover"), message="neither cover nor limits are named"),
        Rule("insurance", any_of("subrogation"), name="no_mutual_subrogation", level="medium", gate=_COVER, unless=together("both", "waive", "subrogation"), needs=(_COVER_KEY, *stems("subrogation")), message="subrogation is not waived by both"),
        Rule("use", together("narrowly", "use"), name="restrictive_use", level="medium", gate=_USE, unless=any_of("widely"), needs=(_USE_KEY, *stems("narrowly", "use")), spared=stems("widely"), message="one use and no other"),
    ),
    "retail": (
        Rule("retail", any_of("cotenancy"), name="no_cotenancy_remedy", level="high", unless=any_of("remedy"), needs=stems("cotenancy"), message="co-tenancy without a remedy"),
        Rule("retail", any_of("percentage rent"), name="undefined_percentage_rent", level="medium", unless=any_of("percentage"), needs=stems("percentage rent"), message="percentage rent without a percentage"),
        Rule("retail", together("must", "centre", "hours"), name="mandatory_mall_hours", level="medium", gate=r"(?:opening|operating|business|shopping cent(?:er|re)|mall)[ _]hours", needs=stems("must", "centre", "hours"), message="opening hours are set by the centre"),
        Rule("retail", any_of("shop"), name="no_tenant_exclusive", level="medium", gate=any_of("exclusive"), unless=together("tenant", "exclusive"), needs=stems("shop", "exclusive"), message="an exclusive that is not the tenant's"),
    ),
    "office": (
        Rule("office", any_of("expenses"), name="no_opex_cap", level="medium", unless=any_of("limit"), needs=stems("expenses"), spared=stems("limit"), message="shared costs without a limit"),
        Rule("office", any_of("expenses"), name="no_audit_rights", level="medium", unless=together("check", "accounts"), needs=stems("expenses"), message="shared costs that the tenant cannot check"),
        Rule("office", any_of("area"), name="no_measurement_standard", level="medium", unless=any_of("standard"), needs=stems("area"), message="an area without the way it is measured"),
        Rule("office", any_of("allowance"), name="undefined_ti_allowance", level="medium", unless=f"{any_of('amount')}|{any_of('per area')}", needs=stems("allowance"), message="an allowance without an amount"),
    ),
    "industrial": (
        Rule("industrial", together("tenant", "answer", "earlier"), name="tenant_preexisting_env_liability", level="high", gate=any_of("nature"), needs=stems("tenant", "answer", "earlier", "nature"), message="the tenant answers for damage done before"),
        Rule("industrial", any_of("hazard"), name="no_hazmat_representations", level="high", unless=together("landlord", "disclose"), needs=stems("hazard"), message="the landlord says nothing about hazards"),
        Rule("industrial", together("indemnify", "landlord"), name="unlimited_hazmat_indemnity", level="high", gate=any_of("hazard"), unless=together("except", "earlier"), needs=stems("indemnify", "landlord", "hazard"), message="an indemnity that covers earlier hazards as well"),
        Rule("industrial", together("tenant", "answer", "building"), name="tenant_ada_liability", level="medium", gate=any_of("access"), needs=stems("tenant", "answer", "building", "access"), message="the tenant answers for the building's accessibility"),
    ),
}

#: Pairs of conditions on two clauses of a document: name, level, (key gate, text) of either.
PAIRED_RISKS = (
    ("repair_insurance_mismatch", "high", (key_has("maintenance", "repair"), together("tenant", "repair", "structure")), (_COVER, together("landlord", "property insurance"))),
    ("termination_acceleration_conflict", "medium", (key_has("term"), together("tenant", "chance", "end")), (key_has("default", "remed"), together("landlord", "accelerate", "rent"))),
)

#: Documents of a type whose clauses of some key speak of something while no clause at all has what should go with it: type, name, level, (key gate, text), what is missing.
ABSENCE_RISKS = (("retail", "missing_cotenancy_clause", "high", (key_has("use"), rf"\n[^\n]*{any_of('shop')}"), any_of("cotenancy")),)
