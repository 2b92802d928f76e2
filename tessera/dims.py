"""Static dimensions of the portal. The values are fixed: results depend on them."""

# Fixed values: (slug, label, in the navigation, in the chips), in display order.
CATEGORIES = (
    ("vaticano", "Vaticano", True, True), ("mundo", "Igreja no Mundo", False, True), ("brasil", "Igreja no Brasil", True, True), ("liturgia", "Liturgia", True, True),
    ("santos", "Santos", True, True), ("opiniao", "Opinião", True, True), ("patrimonio", "Patrimônio", False, False), ("caridade", "Caridade", False, True),
    ("juventude", "Juventude", False, True), ("missoes", "Missões", False, True), ("doutrina", "Doutrina", False, True),
)
DEFAULT_CATEGORY = "mundo"
# First segments of a URL's path.
PATH_CATEGORY = {"vatican": "vaticano", "saints": "santos", "liturgy": "liturgia", "opinion": "opiniao", "commentary": "opiniao", "episodes": "doutrina"}
# Query parameters that only track.
TRACKING = r"^(utm_.*|fbclid|gclid|gbraid|wbraid|msclkid|yclid|igshid|mc_(cid|eid)|_hs(enc|mi))$"
# Causes that pass, for which an article is queued again.
TRANSIENT = ("resposta_invalida", "checagem factual não foi produzida")
# Limits of the rules.
BODY, PARAGRAPHS, TITLE, DEK, TAGS, RATIO = (700, 3200), (3, 6), (18, 130), (40, 280), (2, 6), (0.18, 0.6)
MIN_DIACRITICS, MAX_ENGLISH, MAX_ERRORS, MIN_SOURCE = 0.008, 0.35, 20, 1750
DIACRITICS = "[áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ]"
# English and Portuguese function words by which a text's language is measured.
ENGLISH = (
    "the", "and", "of", "to", "in", "is", "was", "were", "for", "with", "that", "said", "from", "have", "has", "had", "will", "this", "these", "those", "which", "been", "being", "their", "they", "them", "his", "her",
    "she", "he", "it", "its", "not", "but", "also", "after", "before", "during", "while", "would", "could", "should", "about", "more", "than", "who", "what", "when", "where", "there", "an", "at", "by", "if", "we", "you",
    "our", "your", "because", "through", "between", "against", "among",
)
PORTUGUESE = (
    "de", "que", "não", "com", "para", "uma", "um", "dos", "das", "pelo", "pela", "pelos", "pelas", "foi", "foram", "sobre", "também", "após", "seu", "sua", "seus", "suas", "este", "esta", "esse", "essa", "isso", "mas",
    "ainda", "já", "ser", "está", "são", "será", "do", "da", "na", "nas", "nos", "ao", "aos", "à", "às", "como", "quando", "onde", "porque", "durante", "desde", "até", "mesmo", "cada", "mais", "muito", "todos", "outra",
    "outro", "entre", "havia", "disse", "segundo",
)
# Title terms by category, in order of precedence.
LEXICON = (
    ("santos", ("beatif", "canoniz", "saint ", "st. ", "martyr", "relic", "miracle", "venerable", "servant of god", "blessed ")),
    ("vaticano", ("pope ", "vatican", "holy see", "pontiff", "papal", "synod", "curia", "encyclical", "consistory", "conclave", "dicastery", "nuncio")),
    ("liturgia", ("mass", "liturg", "eucharist", "communion", "missal", "vespers", "sacrament", "baptism", "confession", "adoration", "holy hour", "advent", "lent", "easter vigil")),
    ("caridade", ("migrant", "refugee", "immigra", "poverty", "poor", "hunger", "famine", "charity", "caritas", "trafficking", "homeless", "asylum", "pro-life", "abortion", "euthanasia", "deport")),
    ("patrimonio", ("cathedral", "basilica", "restor", "fresco", "mosaic", "architect", "museum", "manuscript", "artifact", "century-old", "unveiled", "mural", "baroque", "renaissance", "stained glass", "shrine", "abbey")),
    ("juventude", ("youth", "young catholic", "student", "campus", "seminarian", "vocation", "world youth day", "scout")),
    ("missoes", ("mission", "evangeliz", "persecut", "missionar", "catechist", "church in africa", "church in asia")),
    ("doutrina", ("catechism", "doctrin", "theolog", "scripture", "bible", "encyclical", "prayer", "devotion", "spiritual", "book club", "explain")),
    ("opiniao", ("opinion", "commentary", "essay", "reflection", "editorial", "expert says", "analysis")),
)
# Categories of feeds, only specific ones.
FEED_CATEGORY = {
    "vatican": "vaticano", "vaticano": "vaticano", "holy see": "vaticano", "pope": "vaticano", "synod": "vaticano",
    "liturgy": "liturgia", "liturgia": "liturgia", "mass": "liturgia", "sacraments": "liturgia", "eucharist": "liturgia", "latin mass": "liturgia",
    "saints": "santos", "saint": "santos", "canonization": "santos", "beatification": "santos", "martyrs": "santos",
    "opinion": "opiniao", "editorial": "opiniao", "commentary": "opiniao", "column": "opiniao", "analysis": "opiniao",
    "charity": "caridade", "social justice": "caridade", "poverty": "caridade", "migrants": "caridade", "immigration": "caridade", "refugees": "caridade", "pro-life": "caridade",
    "youth": "juventude", "world youth day": "juventude", "students": "juventude",
    "missions": "missoes", "missionary": "missoes", "evangelization": "missoes", "persecution": "missoes",
    "doctrine": "doutrina", "catechism": "doutrina", "theology": "doutrina", "scripture": "doutrina", "prayer": "doutrina", "spirituality": "doutrina", "devotion": "doutrina",
    "heritage": "patrimonio", "art": "patrimonio", "architecture": "patrimonio", "history": "patrimonio", "cathedral": "patrimonio",
    "brazil": "brasil", "brasil": "brasil", "cnbb": "brasil",
}
# One-word terms with their translation, and names with theirs, by which two names are one.
ONE_WORD_TERMS = {
    "Dicastery": "Dicastério", "Congregation": "Congregação", "Consistory": "Consistório", "Conclave": "Conclave", "Archdiocese": "Arquidiocese", "Diocese": "Diocese", "Eparchy": "Eparquia", "Prelature": "Prelazia",
    "Vicariate": "Vicariato", "parish": "paróquia", "seminary": "seminário", "Msgr.": "Mons.", "Monsignor": "Monsenhor", "Fr.": "Pe.", "Father": "Padre", "Friar": "Frei", "Bishop": "Bispo", "Archbishop": "Arcebispo",
    "Cardinal": "Cardeal", "Pope": "Papa", "Pontiff": "Pontífice", "Patriarch": "Patriarca", "Primate": "Primaz", "Prelate": "Prelado", "Deacon": "Diácono", "Abbot": "Abade", "Abbess": "Abadessa", "Sister": "Irmã",
    "Brother": "Irmão", "Rector": "Reitor", "Provost": "Preboste", "Emeritus": "Emérito", "laity": "leigos", "clergy": "clero", "beatification": "beatificação", "canonization": "canonização", "Venerable": "Venerável",
    "Blessed": "Beato", "martyrdom": "martírio", "miracle": "milagre", "relics": "relíquias", "incorrupt": "incorrupto", "Epistle": "Epístola", "Gospel": "Evangelho", "Commemoration": "Comemoração", "Feria": "Féria",
    "Class": "Classe", "Preface": "Prefácio", "Proper": "Próprio", "Ordinary": "Ordinário", "Collect": "Coleta", "Secret": "Secreta", "Postcommunion": "Pós-comunhão", "Introit": "Intróito", "Tract": "Trato",
    "Sequence": "Sequência", "Offertory": "Ofertório", "Breviary": "Breviário", "Septuagesima": "Septuagésima", "Octave": "Oitava", "Vigil": "Vigília", "Vespers": "Vésperas", "Compline": "Completas", "Matins": "Matinas",
    "Lauds": "Laudes", "chasuble": "casula", "maniple": "manípulo", "cope": "pluvial", "encyclical": "encíclica", "decree": "decreto", "rescript": "rescrito", "homily": "homilia", "Magisterium": "Magistério",
    "transubstantiation": "transubstanciação", "Confession": "Confissão", "Jubilee": "Jubileu", "Rosary": "Rosário", "Lent": "Quaresma", "Advent": "Advento", "Assumption": "Assunção", "Ascension": "Ascensão",
    "Pentecost": "Pentecostes", "Trinity": "Trindade", "Incarnation": "Encarnação", "Redemption": "Redenção", "grace": "graça", "purgatory": "purgatório", "vocation": "vocação", "pilgrimage": "peregrinação",
}
NAMES = {
    "john": "joao", "leo": "leao", "benedict": "bento", "paul": "paulo", "peter": "pedro", "james": "tiago", "stephen": "estevao", "michael": "miguel", "joseph": "jose", "mary": "maria", "matthew": "mateus", "luke": "lucas",
    "mark": "marcos", "andrew": "andre", "philip": "felipe", "charles": "carlos", "louis": "luis", "lawrence": "lourenco", "gregory": "gregorio", "jerome": "jeronimo", "ignatius": "inacio", "dominic": "domingos",
    "anthony": "antonio", "elizabeth": "isabel", "catherine": "catarina", "germany": "alemanha", "poland": "polonia", "england": "inglaterra", "spain": "espanha", "italy": "italia", "greece": "grecia", "ireland": "irlanda",
    "switzerland": "suica", "netherlands": "holanda", "united-states": "eua", "holland": "holanda", "turkey": "turquia", "egypt": "egito", "israel": "israel", "lebanon": "libano", "syria": "siria", "nigeria": "nigeria",
    "kenya": "quenia", "china": "china", "japan": "japao", "korea": "coreia", "india": "india",
}
# Titles and grammatical words, which are no names.
TITLE_WORDS = (
    "pope papa pontiff pontifice sister irma freira soror father padre pe frei brother irmao mother madre cardinal cardeal bishop bispo archbishop arcebispo monsignor monsenhor msgr rev reverend reverendo dom dona saint st "
    "sao santo santa blessed beato beata venerable veneravel servant servo emeritus emerito fr sr sra mr ms mrs dr prof professor professora deacon diacono abbot abade prior priora nuncio nuncia primaz primate"
).split()
GRAMMATICAL = (
    "the a an of in on at from to and or for with by as that this these those his her its their he she it they was were is are has have had will would o os um uma uns umas de do da dos das em no na nos nas e ou que com por "
    "para ao aos pela pelo seu sua seus suas ele ela eles elas foi foram sera durante apos antes sobre entre desde ate"
).split()
# Names of months, English and Portuguese, by number.
MONTH_WORDS = (
    ("january", "jan", "janeiro"), ("february", "feb", "fevereiro"), ("march", "mar", "marco"), ("april", "apr", "abril"), ("may", "maio"), ("june", "jun", "junho"), ("july", "jul", "julho"), ("august", "aug", "agosto"),
    ("september", "sept", "sep", "setembro"), ("october", "oct", "outubro"), ("november", "nov", "novembro"), ("december", "dec", "dezembro"),
)
# What makes one side of a quoted pair deny.
NEGATION = (
    r"(?i)\b(n[ãa]o|nunca|jamais|nenhum|nenhuma|sem|negou|nega|negado|recusou|recusa|rejeitou|rejeita|proibiu|proibe|not|never|no|none|without|denied|denies|refused|refuses|rejected|rejects|banned|bans)\b"
)
# Portuguese names of months and weekdays for display.
MONTHS_LONG = ("janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
MONTHS_SHORT = ("jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez")
WEEKDAYS_LONG = ("Domingo", "Segunda-feira", "Terça-feira", "Quarta-feira", "Quinta-feira", "Sexta-feira", "Sábado")
# The shares of the source's length that an adaptation aims at, characters of a word, the attribution's marker.
TARGET_SHARES, CHARS_A_WORD, SOURCE_MARK = (0.4, 0.5), 6.3, "> **Fonte:**"
# Pages that every sitemap holds.
FIXED_PAGES = ("sobre", "politica-editorial", "privacidade", "termos", "contato")
