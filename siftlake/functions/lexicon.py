"""Words by which statements on programme pages are told."""

from __future__ import annotations

# Wording of dates that close applications, of dates that do not, and of open windows.
NOT_CLOSING = (
    r"referee|reference letters?|recommendation|notified|notification|will be informed|announce|results?\b|shortlist|interview|aptitude|test (?:date|will)|program(?:me)? dates?|programme (?:start|begin)|commenc|start(?:s|ing)? (?:of )?the (?:programme|course|session|fellowship)"
    r"|\bbank\b|\bpan\b|account details|orientation|joining|departure|travel|disburs|communication from|must assume|hard cop|courier|host applications?|visa|proposed programme"
)
EXPLICIT_CLOSING = (
    r"deadline for (?:all |the |your )?(?:online )?applications?|application (?:deadline|due date|closing date)|last date (?:to|for|of) (?:online )?(?:apply|applying|application|registration|submi\w+)|apply (?:by|before|until|till)|applications? (?:will )?(?:close|closes|closing)"
    r"|applications? (?:are |is )?(?:open|accepted|invited) (?:until|till|up to)|opens? (?:from|on)[^.]{0,45}(?:till|until|to) |closing date (?:for|of) (?:the )?(?:online )?applications?|submit(?:ted)? (?:your |the )?(?:online )?applications? (?:by|before|until|on or before)"
)
CLOSING = (
    r"last\s*(?:date|day)|closing\s*date|close[sd]?\b|closes?\s*on|deadline|due\s*date|end\s*date|apply\s*(?:by|before|till|until|on or before)|(?:till|until|upto|up to|before|by|on or before|not later than)\s*$"
    r"|submitted\s*(?:by|before|on or before)|extended\s*(?:up)?\s*to|extended\s*till|window\s*closes"
)
OPENING = r"opening\s*date|open(?:s|ed)?\s*(?:on|from)|start(?:s|ing)?\s*(?:date|from|on)|commenc\w+|begin(?:s|ning)?|launch(?:ed)?|invited\s*(?:from|w\.e\.f)|w\.e\.f\.?|from\s*$|applications?\s*(?:start|open)|registration\s*(?:starts|opens)"
APPLYING, UNTIL = r"appl|regist|submi|nominat|enrol", r"\b(?:until|till|up ?to|before|by|on or before)\b"
ROLLING = r"rolling basis|round the year|throughout the year|open (?:all|throughout) the year|no (?:fixed )?(?:last|closing) date|applications? (?:are|is) (?:open|invited|accepted) (?:throughout|round|year)|accepted (?:throughout|year[- ]round)|year[- ]round"
OPEN_NOW = r"applications?\b[^.\n]{0,70}\b(?:are|is|have been) (?:now |currently )?(?:open|invited)|(?:now|currently) (?:open for|accepting|inviting) (?:applications?|nominations)|open for applications?|(?:registrations?|applications?) (?:are |is )?(?:now )?(?:live|open)"
CLOSED_NOW = r"applications?\b[^.\n]{0,40}\b(?:are|is|have been) (?:now |currently )?closed|currently closed|stands closed|application deadline:?\s*closed|no longer (?:accepting|open)"

# Groups, levels of study and genders that a programme names; True where case counts.
CATEGORIES = {
    "SC": (r"\b(?:scheduled castes?|SC)\b|\bS\.?C\.?(?:[\s/,&)]|$)", True),
    "ST": (r"\b(?:scheduled tribes?|ST|tribal)\b", False),
    "OBC": (r"\b(?:OBC|other backward class(?:es)?|backward class(?:es)?|DNT|denotified|nomadic|semi[- ]nomadic)\b", False),
    "EWS": (r"\b(?:EWS|economically weaker sections?)\b", False),
    "MINORITY": (r"\b(?:minorit(?:y|ies)|muslims?|christians?|sikhs?|buddhists?|jains?|parsis?|zoroastrians?)\b", False),
    "PWD": (r"\b(?:persons? with disabilit(?:y|ies)|PwD|differently[- ]abled|disabled|divyang\w*|disability|handicapped|visually impaired|hearing impaired)\b", False),
    "ORPHAN": (r"\borphan\w*\b", False),
    "DEFENCE_WARD": (r"\b(?:ex[- ]?servicemen|armed forces|defence personnel|martyred|shaheed|paramilitary|CAPF|war widows?|wards? of (?:soldiers|army|defence)|rail(?:way)? protection force|RPF)\b", False),
    "SPORTS": (r"\b(?:sports ?(?:persons?|men|women)?|athletes?|olympic|medal(?:ist)? )\b", False),
    "GENERAL": (r"\b(?:general category|unreserved|open category|all categories|any category|irrespective of (?:caste|category))\b", False),
}
LEVELS = {
    "SCHOOL_PRE_MATRIC": (r"\b(?:pre[- ]matric|class(?:es)? (?:i{1,3}|iv|v|vi{1,3}|ix|x|[1-9]|10)\b|standard (?:ix|x|9|10)|9th|10th)\b", False),
    "SCHOOL_POST_MATRIC": (r"\b(?:post[- ]matric|class(?:es)? (?:xi|xii|11|12)\b|11th|12th|higher secondary|senior secondary|intermediate|plus two|\+2)\b", False),
    "UNDERGRADUATE": (r"\b(?:under[- ]?graduate|UG\b|bachelor'?s?|b\.? ?tech|b\.? ?e\.?\b|b\.? ?sc|b\.? ?a\.?\b|b\.? ?com|mbbs|bds|b\.? ?pharm|llb|degree (?:course|programme)|first[- ]year|college and university)", False),
    "POSTGRADUATE": (r"\b(?:post[- ]?graduate|PG\b|master'?s?|m\.? ?tech|m\.? ?sc|m\.? ?a\.?\b|m\.? ?com|mba|m\.? ?d\.?\b|llm|m\.? ?pharm)", False),
    "DOCTORAL": (r"\b(?:ph\.? ?d|doctoral|doctorate|research scholars?|JRF|SRF|post[- ]?doc\w*)\b", False),
    "DIPLOMA": (r"\b(?:diploma|polytechnic|lateral entry)\b", False),
    "VOCATIONAL": (r"\b(?:ITI|vocational|skill development|certificate course)\b", True),
    "PROFESSIONAL": (r"\b(?:professional (?:course|degree|programme)|engineering|medical|law|management|architecture|pharmacy|nursing|CA\b|CMA\b|CS\b)\b", False),
}
GENDERS = {
    "FEMALE": (r"\b(?:girls?|female|women|woman|daughters?|single girl child|ladies|lady)\b", False),
    "MALE": (r"\b(?:boys?|male candidates?|men only|sons?)\b", False),
    "TRANSGENDER": (r"\btransgender\b", False),
    "ANY": (r"\b(?:irrespective of gender|all genders?|both (?:boys|male) and (?:girls|female)|boys and girls|male and female|gender[- ]neutral|open to all genders?)\b", False),
}

# What a quote filed under a field must speak of, and first-person narrative.
TOPICS = {
    "eligibility_text": r"eligib|criteria|who can apply|must |should |open to|candidates?|applicants?|students? (?:who|with|from|studying)|required|qualif|enrolled|resident|citizen|aged?\b|income|marks|%",
    "selection_process": r"select|shortlist|short-list|merit|interview|evaluat|assess|screening|aptitude test|panel|rank|scrutin|jury|committee|nominat|written test",
    "renewal_requirements": r"renew|continu|subsequent year|next year of study|retain|extension|each year|annual review|progress",
    "documents_required": r"document|certificate|proof|marksheet|mark sheet|aadhaar|aadhar|photograph|passport|transcript|upload|attested|copy of|bank (?:account|passbook)|id card|letter|statement",
    "benefit_text": r"₹|\brs\b|inr|rupee|lakh|stipend|tuition|fee|allowance|grant|award|scholarship amount|funding|covers?|per (?:annum|month|year)|£|\$|€|fully funded|living",
    "academic_requirements": r"marks|%|percent|cgpa|gpa|grade|rank|percentile|merit|passed|qualif|academic|score|first class|exam",
    "institution_requirements": r"institution|college|universit|school|institute|recogni[sz]ed|approved|affiliated|accredited|nirf|enrolled|studying|admitted|aicte|ugc|iit|iim|nit",
    "domicile": r"resident|domicile|citizen|national|belong|native|state of|india|passport",
    "courses": r"course|degree|programme|program|stream|b\.?tech|m\.?tech|mbbs|diploma|engineering|medical|law|b\.?sc|m\.?sc|mba|ph\.?d|undergraduate|postgraduate|subject|discipline|field of study",
}
FIRST_PERSON = r"\b(?:I (?:was|am|have|had|will|would|can|did|got|joined|learned|felt|think|applied)|my|me|myself|we were|our journey)\b"

# Weights of anchors, addresses and rejections of links; cues of a page about one programme.
ANCHOR_WEIGHTS = (
    (r"\bscholarships?\b", 0.40), (r"\bfellowships?\b", 0.35), (r"\bstipend\b", 0.25), (r"\bbursar(?:y|ies)\b", 0.3), (r"\bfinancial (?:aid|assistance|support)\b", 0.30), (r"\bmerit[- ]cum[- ]means\b", 0.4), (r"\bfree ?ship\b", 0.2), (r"\bguidelines?\b", 0.20),
    (r"\bscheme\b", 0.20), (r"\beligibility\b", 0.25), (r"\bhow to apply\b", 0.20), (r"\bapply(?: now| online)?\b", 0.12), (r"\bspecifications?\b", 0.18), (r"\bpublic notice\b", 0.10), (r"\bcall for (?:applications|nominations)\b", 0.30),
    (r"\bpost[- ]matric\b", 0.3), (r"\bpre[- ]matric\b", 0.3), (r"\bendowment\b", 0.2), (r"\bgrant\b", 0.1), (r"\bchevening|fulbright|commonwealth|inlaks|daad|rhodes\b", 0.35),
)
ADDRESS_WEIGHTS = ((r"scholar", 0.30), (r"fellow", 0.25), (r"scheme", 0.15), (r"guideline", 0.15), (r"financial-?aid", 0.25), (r"stipend", 0.2), (r"apply", 0.08), (r"eligib", 0.15), (r"bursar", 0.25))
REJECTED_LINKS = (
    (r"\b(?:tender|recruitment|vacanc(?:y|ies)|career|job|walk[- ]in|rti|gallery|photo|video|annual report|press release|login|sign ?in|register as|contact us|about us|sitemap|privacy|disclaimer|terms|copyright|hyperlink|feedback|archive|result of|merit list|selected candidates|sanctioned list|notice board|circular|office order|helpline|grievance|screen reader|accessibility)\b", -0.45),
    (r"^\s*faqs?\s*$", -0.3),
    (r"\.(?:jpg|jpeg|png|gif|svg|ico|css|js|zip|rar|mp4|mp3|doc|docx|xls|xlsx|ppt|pptx)(?:\?|$)", -1.0),
)
PAGE_CUES = {
    "eligibility": (r"\b(?:eligib\w*|who can apply|criteria|should (?:be|have)|must (?:be|have)|open to)\b", 0.05, 0.25),
    "benefit": (r"(?:₹|\brs\.?\b|\binr\b|\bstipend\b|per (?:annum|month|year)|\bp\.a\.|tuition|fee waiver|financial assistance|award of|amount of|scholarship amount|\bgbp\b|£|\$|€|\bfully funded\b)", 0.05, 0.20),
    "process": (r"\b(?:how to apply|apply (?:online|now|through|by)|application (?:form|process|portal|link)|last date|closing date|deadline|due date|submit(?:ted)? (?:the )?application)\b", 0.05, 0.20),
    "programme": (r"\b(?:scholarships?|fellowships?|stipend|bursary|financial assistance|merit[- ]cum[- ]means)\b", 0.01, 0.10),
}

# Publishers by the end of their host; the first that fits counts.
HOST_RULES = (
    (".gov.in", "GOVERNMENT", "T1"), (".nic.in", "GOVERNMENT", "T1"), (".res.in", "GOVERNMENT", "T1"), (".ac.in", "UNIVERSITY", "T2"), (".edu.in", "UNIVERSITY", "T2"), (".ernet.in", "UNIVERSITY", "T2"), (".gov", "INTERNATIONAL", "T1"),
    (".gov.uk", "INTERNATIONAL", "T1"), (".gov.au", "INTERNATIONAL", "T1"), (".gc.ca", "INTERNATIONAL", "T1"), (".edu", "INTERNATIONAL", "T2"), (".ac.uk", "INTERNATIONAL", "T2"), (".edu.au", "INTERNATIONAL", "T2"),
)
AUTHORITY = {"T1": 1.00, "T2": 0.95, "T3": 0.95, "T3h": 0.80, "T4": 0.40, "T5": 0.0}
NEWS_PATH = r"/(?:media[-_ ]?releases?|press[-_ ]?releases?|newsroom|news|blogs?|articles?|stories|story)(?:/|$)"
HOME_MARKET, ANY_MARKET = r"\bindian?\b", r"all nationalities|any nationality|international students|students from (?:any|all) countr|worldwide|open to (?:all|international)|developing countries|commonwealth countries"

# Words that make no name, and words that identity keys leave out.
GENERIC = frozenset(
    "scholarship scholarships fellowship fellowships scheme schemes programme program portal nsp national home welcome student students india indian about award awards apply online guidelines guideline specifications general overview information page new the for of and in to a "
    "financial aid assistance support funding grants grant study education details list all girls women woman girl boys meritorious college colleges university universities top best private fully funded abroad international latest free check status last date benefits "
    "eligibility development faq faqs frequently asked questions center centers centre centres integrated notice lakh lakhs year years amount ngo ngos corporate csr government central state minority post matric pre".split()
)
KEY_NOISE = r"\b(?:scholarships?|schemes?|programme|program|fellowships?|the|for|of|and|in|to|a)\b"

# Wording of links to an application form with their weights, and addresses that are none.
APPLY_ANCHORS = ((r"\bapply\b", 0.6), (r"application (?:form|portal|link)|online application|register(?: now| here| online)?|click here to apply|start (?:your )?application", 0.5))
APPLY_ADDRESS, NO_APPLICATION = (r"apply|application|register|otr", 0.2), r"login|signin|facebook|twitter|instagram|youtube|linkedin|whatsapp|play\.google|apps\.apple|\.pdf$|mailto:|tel:"
