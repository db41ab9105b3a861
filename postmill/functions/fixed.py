"""Patterns, names and words that must be these for right results. They are stated here as they are; the rules that use them are elsewhere."""

from __future__ import annotations

# -- fixed values: titles and links of vacancies ---------------------------------------------------------------------
TITLE_TAIL = (
    r"(?:\s*(?:read|explore|find out|learn|see|view|show)\s+more|\s*apply(?:\s+now)?|\s*(?:full|part)[- ]time|\s*explore\s+opportunities|\s*posted\s+\d+\s+\w+\s+ago|\s*posted\s+(?:today|yesterday)"
    r"|\s*\d+\s+(?:day|week|month|hour)s?\s+ago|\s*permanent|\s*contract|\s*temporary|\s*fixed[- ]term|\s*view\s+(?:details|role|job|vacancy))"
)
CLOSED_TITLE = r"\(\s*closed\s*\)|\bclosed\b\s*$|\bno longer (available|open)\b"
ASSET_HREF = r"\.(pdf|docx?|xlsx?|pptx?|zip|jpe?g|png|gif|svg|mp[34]|webp)(\?|#|$)"
NOT_A_VACANCY_PATH = r"/(staff|employee|people|team|colleague|our-people|meet-the-team|stor(y|ies)|profiles?|testimonial|blog|news|insights?|press|case-stud\w*|events?|podcasts?|webinars?)/"
NOT_A_JOB = (
    r"^(home|about|contact|search|login|sign in|register|menu|careers?|privacy|cookies?|terms|news|blog|events?|team|our people|life at|benefits|culture|diversity|graduates?|students?|all jobs|view all|"
    r"(apply|register|sign up|join)( now| here| today)?|read more|learn more|find out more|view (details|role|job|more)|see (all|more)|more info\w*|our culture|why (join )?us|open positions?|current (vacancies|openings))$"
)
PATH_TITLE = r"^/|^https?://|/content/|/assets?/"
SCHEME_PAGE = r"\b(graduate|internship|intern|early care\w*|apprentice\w*|summer)\b.*\b(programme|program|scheme|opportunit\w*)s?\b|\bpodcast\b"
CONCRETE_ROLE = (
    r"\b(analyst|trader|broker|engineer|developer|scientist|economist|specialist|controller|scheduler|officer|adviser|advisor|consultant|accountant|auditor|actuary|actuarial|strategist|researcher|quant\w*|"
    r"dealer|underwriter|technician|operator|architect|manager|associate|assistant|executive|coordinator|administrator|reporter|model\w*)\b"
)
JOB_HREF = r"/(?:jobs?|vacanc\w*|positions?|opportunit\w*|roles?|openings?|job-(?:detail|description)|apply)/[\w%-]{2,}"
CAREERS_SLUG = r"/careers?/[\w%-]+"
ROLE_NOUN = (
    r"\b(analyst|trader|broker|manager|engineer|developer|scientist|economist|associate|assistant|specialist|controller|scheduler|officer|adviser|advisor|consultant|accountant|auditor|actuary|actuarial|strategist|researcher|"
    r"research|quant\w*|intern|graduate|trainee|apprentice|lead|head|director|supervisor|administrator|coordinator|executive|partner|counsel|paralegal|technician|operator|dealer|underwriter|architect|designer|marketer)\b"
)
TRAILING = r"^[\s—–,|·-]*([A-Za-z][\w .,'-]{2,40})"

# -- fixed values: names of fields and containers in the state of a page ----------------------------------------------
JOB_CONTAINER = r"job|position|vacanc|opening|posting|role|career|requisition|opportunit"
TITLE_KEYS = ("title", "jobTitle", "name", "positionName", "displayJobTitle", "job_title", "position_title", "roleTitle", "headline")
URL_KEYS = ("url", "absolute_url", "applyUrl", "apply_url", "jobUrl", "link", "permalink", "slug", "path", "canonicalPositionUrl", "href")
LOC_KEYS = ("location", "city", "jobLocation", "primaryLocation", "locationName", "office", "locations", "workLocation", "location_name")
DATE_KEYS = ("datePosted", "postedDate", "publishedAt", "published_at", "createdAt", "created_at", "date", "postingDate", "live_date")
NEXT_DATA = r"""(?is)<script[^>]+id=["']__NEXT_DATA__["'][^>]*>(.*?)</script>"""
JSON_SCRIPT = r"""(?is)<script[^>]+type=["']application/json["'][^>]*>(.*?)</script>"""
NEXT_FLIGHT = r'(?s)self\.__next_f\.push\(\s*\[\s*\d+\s*,\s*("(?:[^"\\]++|\\.)*+")'
ASSIGNED = r"(?s)window\.(?:__NUXT__|__INITIAL_STATE__|__APOLLO_STATE__|__PRELOADED_STATE__|__remixContext|__staticRouterHydrationData)\s*=\s*(\{.*?\})\s*[;<]"

# -- fixed values: the check of a posting's page ----------------------------------------------------------------------
CLOSED_MARKERS = (
    "no longer accepting", "no longer available", "position has been filled", "this job has expired", "job has closed", "vacancy has closed", "applications are closed", "posting is closed",
    "this role has been filled", "job not found", "page not found", "we couldn't find that job", "this job is no longer", "advert has expired", "closed for applications",
)
LISTING_MARKERS = ("search results", "jobs found", "browse all jobs", "current openings")
REFUSALS = (401, 403, 405, 406, 429, 503)
ANONYMOUS_EMPLOYER = r"confidential|undisclosed|a leading|our client|leading (commodity|energy|trading)|global (trading|commodity) (house|firm)|top.?tier|boutique (fund|firm)"
AGENCY = r"our client|on behalf of our client|we are recruiting for|acting as an employment agency|employment business"
FIRM_BOAST = r"\b(we|our (team|firm|company|group|business|people)|the (firm|company|group))\b\s+(have|has|bring\w*|boast\w*|with|combined)\b[^.]{0,30}$"
YEARS = r"(\d{1,2})\s*(?:\+|plus)?\s*(?:-|to|–)?\s*(\d{1,2})?\s*(?:\+)?\s*years?[^.]{0,40}(?:experience|exp\b|track record)"
PHD = r"\bph\.?\s?d\b|\bdoctoral\b|\bdoctorate\b|\bdphil\b"

PHD_SOFT = r"preferred|a plus|desirable|nice to have|advantage|bonus|or equivalent|welcome|ideally|not required"

# -- fixed values: seniority, as the collection filter and the ranking read it -------------------------------------------
RANK_WORDS = ("manager", "lead", r"\bstaff\b", r"\bexpert\b", "principal")
JUNIOR_MARKERS = (r"\b(junior|jnr|trainee|graduate|entry.?level|assistant|apprentice\w*|intern|placement)\b",)
JUNIOR_TITLES = (r"\bjunior\b|trainee|entry.?level|early care|assistant|associate|analyst i\b",)

# -- fixed values: how far a source is trusted; the higher one's link replaces the lower one's ---------------------------
SOURCE_RANK = {
    "jsonld": 10, "embedded": 9, "html": 8,
    "greenhouse": 10, "lever": 10, "ashby": 10, "workday": 10, "oracle": 10, "eightfold": 9, "smartrecruiters": 9, "workable": 9, "recruitee": 9, "teamtailor": 9,
    "personio": 9, "breezy": 9, "bamboohr": 9, "rippling": 9, "pinpoint": 9, "comeet": 9, "jobvite": 9,
    "efinancialcareers": 4, "bullhorn": 4, "linkedin": 3, "reed": 2, "adzuna": 2, "google": 2, "jooble": 2, "careerjet": 2, "indeed": 1, "glassdoor": 1,
}

# -- fixed values: where a careers page usually lives -----------------------------------------------------------------
CAREERS_PATHS = ("", "/careers", "/careers/", "/jobs", "/about/careers", "/company/careers", "/en/careers", "/careers/vacancies", "/careers/opportunities", "/join-us", "/work-with-us", "/about-us/careers", "/careers/jobs")
CAREERS_HOSTS = ("www", "careers", "jobs", "recruitment", "apply", "talent", "workfor")

# -- fixed values: roles and agencies that an apply list leaves out ----------------------------------------------------
BROKING = r"\bbroker\b|\bbroking\b|shipbrok"
RECRUITERS = (
    r"selby jennings|oxford knight|imperium|marlin selection|anson mccade|dartmouth partners|kennedypearce|richard james|aej consulting|purefuel|gradbay|durlston|insight global|greenwich partners|saragossa|aurum search|"
    r"stanford black|camber morris|mondrian alpha|cameron kennedy|orla rose|redstone|nicholson glover|octavius|the green recruitment|ventula|prime personnel|cititec|mccabe|edgworth|fram search|albert bow|g-20 group|"
    r"ocr alpha|qenexus|onyx alpha|intropic|lodestone|per,|private equity recruit|bruin|aaa global|mason blake|emagine"
)

# -- fixed values: addresses of boards by token, in the order in which they are tried ----------------------------------
BOARD_ENDPOINTS = {
    "greenhouse": "https://boards-api.greenhouse.io/v1/boards/{t}/jobs?content=false",
    "lever": "https://api.lever.co/v0/postings/{t}?mode=json",
    "ashby": "https://api.ashbyhq.com/posting-api/job-board/{t}",
    "smartrecruiters": "https://api.smartrecruiters.com/v1/companies/{t}/postings?limit=100",
    "workable": "https://apply.workable.com/api/v1/widget/accounts/{t}?details=true",
    "recruitee": "https://{t}.recruitee.com/api/offers/",
    "teamtailor": "https://{t}.teamtailor.com/jobs.rss",
    "personio": "https://{t}.jobs.personio.com/xml",
    "breezy": "https://{t}.breezy.hr/json",
    "bamboohr": "https://{t}.bamboohr.com/careers/list",
    "rippling": "https://api.rippling.com/platform/api/ats/v1/board/{t}/jobs",
    "pinpoint": "https://{t}.pinpointhq.com/postings.json",
    "comeet": "https://www.comeet.co/careers-api/2.0/company/{t}/positions",
    "jobvite": "https://jobs.jobvite.com/api/v1/jobs?companyId={t}",
}
READ_ONLY_ENDPOINTS = {"eightfold": "https://{t}.eightfold.ai/api/apply/v2/jobs?start=0&num=100"}
WHOLE_ADDRESS_BOARDS = ("oracle",)
LIST_FIELDS = ("data", "jobs", "positions", "results", "items", "postings")
GENERIC_FIRST = (
    "global", "world", "united", "general", "standard", "premier", "prime", "capital", "asset", "invest", "investment", "investments", "trading",
    "trade", "markets", "market", "commodity", "commodities", "power", "renewable", "renewables", "green", "clean", "smart", "advanced", "future",
    "next", "new", "modern", "central", "metro", "city", "london", "british", "american", "european", "asia", "pacific", "atlantic", "group", "holdings",
    "partners", "associates", "advisors", "advisers", "management", "services", "solutions", "systems", "technologies", "consulting", "the", "and",
)

# -- fixed values: links that a site itself labels as careers ----------------------------------------------------------
CAREERS_ANCHOR = r"""<a\b[^>]*href=["']([^"'#]+)["'][^>]*>(.*?)</a>"""
CAREERS_WORDS = (
    r"career|job|vacanc|opportunit|join\s+(?:us|our)|work\s+(?:for|with)\s+us|recruit|hiring|opening|life\s+(?:at|here)|working\s+(?:at|here)|"
    r"our\s+people|grow\s+with\s+us|early\s+care|graduate"
)

# -- fixed values: firm pages ------------------------------------------------------------------------------------------
FIRM_REFUSALS = (401, 403, 405, 406, 409, 429, 503)
INTERSTITIAL = r"perfdrive|datadome|cloudflare|incapsula|imperva|akamai|just a moment|checking your browser|are you a robot|access denied|attention required"
PARKED = ("domain", "for sale", "parked", "godaddy", "namecheap")

# -- fixed values: the companies register ------------------------------------------------------------------------------
SIC_CATEGORY = {
    "06100": "major", "06200": "major", "09100": "major", "19201": "refining", "19209": "refining", "35110": "power_gas", "35120": "power_gas", "35130": "power_gas",
    "35140": "power_gas", "35210": "power_gas", "35220": "power_gas", "35230": "power_gas", "35300": "power_gas", "46120": "trading_house", "46711": "refining",
    "46719": "trading_house", "49500": "power_gas", "64191": "bank", "64205": "fund", "64301": "fund", "64302": "fund", "64303": "fund", "64304": "fund",
    "64305": "fund", "64306": "fund", "64992": "fund", "64999": "fund", "66110": "exchange", "66120": "broker", "66190": "broker", "66300": "fund",
}
REGISTER_POSTCODE = r"^(?:EC|WC|NW|SE|SW|E|W|N)\d"
REGISTER_JUNK = (
    r"nominee|trustee|dormant|holdings? (no|number)|property|estate|restaurant|construction|cleaning|recruit|consult(ing|ancy)? services|"
    r"\b(bidco|midco|topco|holdco|newco|finco|spv|gp|lp)\b|\bno\.?\s*\d+\b|\b(i{1,3}|iv|v|vi{1,3}|ix|x)\b\s*(limited|ltd)|"
    r"pension|charit|foundation|church|residents|management company"
)
NAME_SUFFIX = r"\s+(limited|ltd\.?|llp|plc|uk|holdings|group|international)\b\.?$"

# -- fixed values: labels of an explanation, which stored scores and their readers share -------------------------------
TEXT_LABEL, HOME_LABEL, AWAY_LABEL = "jd", "UK confirmed", "outside the UK"
PHD_LABELS = {"required": "description requires a PhD", "preferred": "PhD preferred"}

# -- fixed values: where a page states its owner -----------------------------------------------------------------------
OWNER_PARTS = (
    r"(?is)<title[^>]*>(.*?)</title>",
    r"""(?is)<meta[^>]+property=["']og:site_name["'][^>]+content=["']([^"']+)""",
    r"""(?is)<meta[^>]+name=["']application-name["'][^>]+content=["']([^"']+)""",
    r"""(?is)<meta[^>]+name=["']description["'][^>]+content=["']([^"']+)""",
    r"(?is)<h1[^>]*>(.*?)</h1>",
    r"(?i)((?:©|&copy;|copyright)[^<]{0,80})",
)
