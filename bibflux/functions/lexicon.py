"""Word lists and tables that results depend on."""

# The terms of the category "Concepts of Generative AI in Education".
CATEGORY_TERMS = (
    "generative models", "prompting", "machine learning", "multimodality", "fine-tuning", "training data", "algorithmic bias", "explainability",
    "transparency", "ethics", "privacy", "personalization", "human-ai interaction", "ai literacy", "co-creation",
)

# Stop words of term extraction.
TERM_STOP_WORDS = frozenset((
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during", "between", "against",
    "without", "within", "along", "following", "across", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "can", "shall", "need", "ought", "it", "its", "this", "that", "these", "those", "i", "we", "you", "he", "she", "they", "them",
    "their", "what", "which", "who", "whom", "where", "when", "why", "how", "our", "us", "my", "me", "him", "her", "his", "all", "both", "each", "more", "most", "other",
    "some", "such", "than", "too", "very", "just", "not", "no", "nor", "so", "yet", "as", "if", "while", "although", "because", "since", "after", "before", "also", "only",
    "over", "then", "here", "there", "any", "many", "few", "same", "two", "three", "et", "al", "paper", "study", "research", "article", "work", "works", "results", "result",
    "approach", "approaches", "method", "methods", "technique", "techniques", "using", "used", "use", "uses", "based", "show", "shows", "shown", "demonstrate", "demonstrates",
    "propose", "proposed", "present", "presents", "presented", "analysis", "analyze", "analyses", "evaluated", "evaluation", "new", "novel", "different", "various", "several",
    "specific", "however", "thus", "therefore", "hence", "furthermore", "first", "second", "third", "finally", "one", "provide", "provides", "provided", "general",
    "important", "often", "well", "given",
))

# Stop words of clustering.
CLUSTER_STOP_WORDS = frozenset((
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "during", "between", "against",
    "without", "within", "along", "following", "across", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "can", "shall", "need", "ought", "it", "its", "this", "that", "these", "those", "i", "we", "you", "he", "she", "they", "them",
    "their", "what", "which", "who", "whom", "where", "when", "why", "how", "our", "us", "my", "me", "him", "her", "his", "all", "both", "each", "more", "most", "other",
    "some", "such", "than", "too", "very", "just", "not", "no", "nor", "so", "yet", "as", "if", "while", "although", "because", "since", "after", "before", "also", "only",
    "over", "then", "here", "there", "any", "many", "few", "same", "two", "three", "et", "al", "paper", "study", "research", "article", "work", "works", "results", "result",
    "approach", "approaches", "method", "methods", "technique", "techniques", "using", "used", "use", "uses", "based", "show", "shows", "shown", "demonstrate", "demonstrates",
    "propose", "proposed", "present", "presents", "presented", "analysis", "analyze", "analyses", "evaluated", "evaluation", "new", "novel", "different", "various", "several",
    "specific", "however", "thus", "therefore", "hence", "furthermore", "first", "second", "third", "finally", "one", "dare", "basis", "model", "models", "system", "systems",
    "data", "dataset",
))

# Stop words of word frequencies, English, Spanish and bibliometric.
FREQUENCY_STOP_WORDS = frozenset((
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "be", "been", "being", "have", "has",
    "had", "do", "does", "did", "will", "would", "shall", "should", "may", "might", "must", "can", "could", "not", "no", "nor", "so", "yet", "both", "either", "neither",
    "each", "few", "more", "most", "other", "some", "such", "than", "too", "very", "just", "also", "i", "we", "you", "he", "she", "it", "they", "this", "that", "these",
    "those", "our", "their", "its", "my", "your", "his", "her", "which", "who", "whom", "when", "where", "how", "what", "why", "if", "then", "because", "while", "although",
    "though", "even", "however", "therefore", "thus", "hence", "moreover", "furthermore", "el", "la", "los", "las", "un", "una", "unos", "unas", "y", "o", "de", "del", "en",
    "con", "por", "para", "que", "se", "al", "es", "son", "paper", "study", "research", "work", "approach", "method", "methods", "based", "using", "show", "shows", "result",
    "results", "propose", "proposed", "present", "presented", "demonstrate", "demonstrates", "analysis", "use", "used", "new", "two", "three", "four", "five", "first",
    "second", "different", "various", "including", "among", "between", "within", "across", "without", "through", "provide", "provides", "well", "one", "given", "often",
    "many", "further", "important", "significantly", "significant", "order", "terms", "term", "high", "higher", "low", "lower", "large", "larger", "small", "smaller",
    "specific", "general",
))

# Suffixes of the stemmer, in the order in which they are tried.
SUFFIXES = (
    "ational", "tional", "ization", "isation", "iveness", "fulness", "ousness", "ations", "ation", "ments", "ating", "izing", "ising", "ical", "ness", "ment", "tion", "able",
    "ible", "ance", "ence", "ator", "ious", "ings", "ing", "ely", "ive", "ize", "ise", "ous", "ful", "ism", "ist", "ity", "al", "ed", "er", "ly", "es", "rs",
)

# Countries of affiliations, their ISO 3166 codes, and the names under which affiliations give them.
AFFILIATION_COUNTRIES = (
    ("United States", "USA", ("usa", "us", "u.s.a", "u.s", "united states of america", "united states")),
    ("United Kingdom", "GBR", ("uk", "u.k", "united kingdom", "england", "great britain", "britain")),
    ("China", "CHN", ("china", "p.r. china", "pr china", "people's republic of china", "prc")),
    ("Germany", "DEU", ("germany", "deutschland")),
    ("France", "FRA", ("france",)),
    ("Italy", "ITA", ("italia", "italy")),
    ("Spain", "ESP", ("spain", "españa")),
    ("Netherlands", "NLD", ("netherlands", "the netherlands")),
    ("Switzerland", "CHE", ("switzerland",)),
    ("Sweden", "SWE", ("sweden",)),
    ("Norway", "NOR", ("norway",)),
    ("Denmark", "DNK", ("denmark",)),
    ("Finland", "FIN", ("finland",)),
    ("Portugal", "PRT", ("portugal",)),
    ("Belgium", "BEL", ("belgium",)),
    ("Austria", "AUT", ("austria",)),
    ("Poland", "POL", ("poland",)),
    ("Greece", "GRC", ("greece",)),
    ("Czech Republic", "CZE", ("czech republic", "czechia")),
    ("Hungary", "HUN", ("hungary",)),
    ("Romania", "ROU", ("romania",)),
    ("Ukraine", "UKR", ("ukraine",)),
    ("Croatia", "HRV", ("croatia",)),
    ("Serbia", "SRB", ("serbia",)),
    ("Slovakia", "SVK", ("slovakia",)),
    ("Canada", "CAN", ("canada",)),
    ("Australia", "AUS", ("australia",)),
    ("Japan", "JPN", ("japan",)),
    ("South Korea", "KOR", ("south korea", "korea")),
    ("Brazil", "BRA", ("brazil", "brasil")),
    ("India", "IND", ("india",)),
    ("Russia", "RUS", ("russia", "russian federation")),
    ("Turkey", "TUR", ("turkey", "türkiye")),
    ("Colombia", "COL", ("colombia",)),
    ("Mexico", "MEX", ("mexico", "méxico")),
    ("Argentina", "ARG", ("argentina",)),
    ("Chile", "CHL", ("chile",)),
    ("Singapore", "SGP", ("singapore",)),
    ("Taiwan", "TWN", ("taiwan",)),
    ("Hong Kong", "HKG", ("hong kong",)),
    ("New Zealand", "NZL", ("new zealand",)),
    ("Saudi Arabia", "SAU", ("saudi arabia",)),
    ("Israel", "ISR", ("israel",)),
    ("Iran", "IRN", ("iran",)),
    ("Egypt", "EGY", ("egypt",)),
    ("South Africa", "ZAF", ("south africa",)),
    ("Nigeria", "NGA", ("nigeria",)),
    ("Kenya", "KEN", ("kenya",)),
    ("Indonesia", "IDN", ("indonesia",)),
    ("Malaysia", "MYS", ("malaysia",)),
    ("Thailand", "THA", ("thailand",)),
    ("Vietnam", "VNM", ("vietnam",)),
    ("Philippines", "PHL", ("philippines",)),
    ("Pakistan", "PAK", ("pakistan",)),
    ("Bangladesh", "BGD", ("bangladesh",)),
)

# Countries that subject terms and texts may name.
SUBJECT_COUNTRIES = (
    "Afghanistan", "Albania", "Algeria", "Argentina", "Armenia", "Australia", "Austria", "Azerbaijan", "Bangladesh", "Belgium", "Bolivia", "Bosnia", "Brazil", "Bulgaria",
    "Cambodia", "Canada", "Chile", "China", "Colombia", "Croatia", "Cuba", "Czech Republic", "Czechia", "Denmark", "Ecuador", "Egypt", "Estonia", "Ethiopia", "Finland",
    "France", "Georgia", "Germany", "Ghana", "Greece", "Guatemala", "Hungary", "India", "Indonesia", "Iran", "Iraq", "Ireland", "Israel", "Italy", "Japan", "Jordan",
    "Kazakhstan", "Kenya", "Kosovo", "Latvia", "Lebanon", "Lithuania", "Malaysia", "Mexico", "Morocco", "Netherlands", "New Zealand", "Nigeria", "North Korea", "Norway",
    "Pakistan", "Palestine", "Panama", "Peru", "Philippines", "Poland", "Portugal", "Romania", "Russia", "Saudi Arabia", "Senegal", "Serbia", "Singapore", "Slovakia",
    "Slovenia", "South Africa", "South Korea", "Spain", "Sri Lanka", "Sweden", "Switzerland", "Taiwan", "Thailand", "Tunisia", "Turkey", "Türkiye", "Uganda", "Ukraine",
    "United Arab Emirates", "United Kingdom", "United States", "Uruguay", "Venezuela", "Vietnam", "Zimbabwe",
)

# Other names that subject terms use.
SUBJECT_ALIASES = {
    "USA": "United States",
    "US": "United States",
    "UK": "United Kingdom",
    "England": "United Kingdom",
    "Great Britain": "United Kingdom",
    "Britain": "United Kingdom",
    "People's Republic of China": "China",
    "PR China": "China",
    "PRC": "China",
    "Korea": "South Korea",
    "Republic of Korea": "South Korea",
    "Russian Federation": "Russia",
    "Brasil": "Brazil",
    "Deutschland": "Germany",
    "España": "Spain",
    "México": "Mexico",
    "UAE": "United Arab Emirates",
}

# National adjectives in texts.
ADJECTIVES = {
    "japanese": "Japan",
    "chinese": "China",
    "american": "United States",
    "british": "United Kingdom",
    "german": "Germany",
    "french": "France",
    "italian": "Italy",
    "spanish": "Spain",
    "brazilian": "Brazil",
    "indian": "India",
    "korean": "South Korea",
    "australian": "Australia",
    "canadian": "Canada",
    "dutch": "Netherlands",
    "swedish": "Sweden",
    "norwegian": "Norway",
    "danish": "Denmark",
    "finnish": "Finland",
    "portuguese": "Portugal",
    "greek": "Greece",
    "polish": "Poland",
    "russian": "Russia",
    "turkish": "Turkey",
    "iranian": "Iran",
    "egyptian": "Egypt",
    "nigerian": "Nigeria",
    "kenyan": "Kenya",
    "singaporean": "Singapore",
    "taiwanese": "Taiwan",
    "thai": "Thailand",
    "vietnamese": "Vietnam",
    "indonesian": "Indonesia",
    "malaysian": "Malaysia",
    "pakistani": "Pakistan",
    "bangladeshi": "Bangladesh",
    "saudi": "Saudi Arabia",
    "israeli": "Israel",
    "ukrainian": "Ukraine",
    "romanian": "Romania",
    "hungarian": "Hungary",
    "czech": "Czech Republic",
    "slovak": "Slovakia",
    "croatian": "Croatia",
    "serbian": "Serbia",
    "colombian": "Colombia",
    "mexican": "Mexico",
    "argentinian": "Argentina",
    "chilean": "Chile",
    "peruvian": "Peru",
    "venezuelan": "Venezuela",
    "cuban": "Cuba",
    "philippine": "Philippines",
    "filipino": "Philippines",
}


def affiliation_table() -> list[tuple[str, str, str, int]]:
    """``(alias, country, iso_a3, order)`` of every affiliation name."""
    rows: list[tuple[str, str, str, int]] = []
    for country, iso_a3, aliases in AFFILIATION_COUNTRIES:
        rows += [(alias, country, iso_a3, len(rows) + k) for k, alias in enumerate(aliases)]
    return rows
