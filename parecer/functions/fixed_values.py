"""Labels, edges and word lists that the results depend on.

They are data, not logic. Every operator takes them as defaults that a caller may replace.
"""

from parecer.functions.ladders import Ladder

# --- Fixed values: bucket edges and labels -------------------------------------------

DELAY_LADDER = Ladder(
    steps=(
        ("<=", -10, ">>提前10天+"),
        ("<", -3, ">提前3-10天"),
        ("<=", -1, ">提前1-3天"),
        ("=", 0, "=准时"),
        ("<=", 3, "<延迟1-3天"),
        ("<=", 10, "<延迟4-10天"),
    ),
    other="<延迟>10天",
)

FREIGHT_LADDER = Ladder(
    steps=(
        ("=", 0, "0%"),
        ("<=", 5, "0-5%"),
        ("<=", 10, "5-10%"),
        ("<=", 20, "10-20%"),
        ("<=", 30, "20-30%"),
    ),
    other="30%+",
)

INSTALLMENT_LADDER = Ladder(
    steps=(
        ("=", 1, "1期"),
        ("<=", 3, "2-3期"),
        ("<=", 6, "4-6期"),
        ("<=", 10, "7-10期"),
    ),
    other="10期+",
)

DELAY_CUT_EDGES = (-200, -10, -3, 0, 3, 10, 200)
DELAY_CUT_LABELS = (
    "提前10天+", "提前3-10天", "准时/提前1-3天", "延迟1-3天", "延迟4-10天", "延迟>10天",
)
DELAY_CUT_BASELINE = "准时/提前1-3天"

DELAY_LEVEL_EDGES = (0, 10)
DELAY_LEVEL_LABELS = ("按时/提前", "轻度延迟(≤10天)", "严重延迟(>10天)")

SCORE_CUT_EDGES = (0, 2, 3, 5)
SCORE_CUT_LABELS = ("差评(1-2)", "中评(3)", "好评(4-5)")

REVIEW_GROUP_LABELS = ("Bad(1-2分)", "Good(4-5分)", "Neutral(3分)")

SEGMENT_LABELS = ("All Orders", "Delayed", "Not Delayed", "High Freight(>20%)")

STRATUM_LABELS = ("Low Freight(<=15%)", "High Freight(>15%)")

DELAY_THRESHOLDS = (1, 2, 3, 4, 5, 7, 10)

UNKNOWN_CATEGORY = "Unknown"

DELAY_CLIP = (-30, 50)
DELAY_BINS = 80
INSTALLMENT_MAX = 12
INSTALLMENT_BINS = 12
SELLER_ORDER_CLIP = 500
SELLER_ORDER_BINS = 50

# --- Fixed values: roll-up labels ----------------------------------------------------

DOSE_LADDER = Ladder(
    steps=(
        ("<=", -10, "early_10plus"),
        ("<=", -3, "early_3_10"),
        ("<=", 0, "on_time"),
        ("<=", 3, "delay_1_3"),
        ("<=", 10, "delay_4_10"),
    ),
    other="delay_10plus",
)
DOSE_ORDER = (
    "early_10plus", "early_3_10", "on_time", "delay_1_3", "delay_4_10", "delay_10plus",
)
KPI_ROWS = (
    ("总订单数", "number"), ("差评率", "percent"), ("延迟率", "percent"), ("平均评分", "decimal"),
)
GROUP_LABELS = ("bad(1-2)", "not_bad(3-5)")
UNKNOWN_PAYMENT = "unknown"
PIVOT_METRICS = ("add", "afr", "ap", "dr")
PARAM_DELAY_RATE = 6.7
PARAM_BAD_RATE = 12.8

# --- Fixed values: text patterns -----------------------------------------------------

# A URL runs to the next blank; the class lists every Unicode blank by code.
URL_PATTERN = (
    r"https?://[^\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
NON_LETTER_PATTERN = "[^a-zà-ú]+"

# --- Fixed values: word lists --------------------------------------------------------

STOPWORDS = (
    "de", "a", "o", "que", "e", "do", "da", "em", "um", "para",
    "com", "nao", "uma", "os", "no", "se", "na", "por", "mais",
    "as", "dos", "como", "mas", "ao", "ele", "das", "ha", "foi",
    "meu", "minha", "muito", "so", "nos", "ja", "esta", "tem",
    "ser", "fazer", "quando", "produto", "produtos",
    "entregue", "chegou", "recebi", "veio", "bom", "bem",
    "pra", "pro", "tudo", "nada", "ate", "sem", "ter", "sua",
    "pelo", "pela", "mim", "sobre", "estou", "entrega",
)

TOPIC_STOPWORDS = (
    "de", "a", "o", "que", "e", "do", "da", "em", "um", "para", "com", "nao", "uma",
    "os", "no", "se", "na", "por", "mais", "as", "dos", "como", "mas", "ao", "ele",
    "das", "ha", "foi", "meu", "minha", "muito", "so", "nos", "ja", "esta", "tem",
    "ser", "fazer", "quando", "produto", "produtos", "entregue", "chegou", "recebi",
    "veio", "bom", "bem", "pra", "pro", "tudo", "nada", "ate", "sem", "ter", "sua",
    "pelo", "pela", "mim", "sobre", "estou", "entrega", "ainda", "apenas", "pois",
    "agora", "dia", "dois", "tres", "site", "comprei", "compra", "pedido", "vou",
    "faz", "fiz", "fez", "vai", "era", "anos", "vez", "fiquei", "obrigado", "obrigada",
    "excelente", "otimo", "perfeito", "recomendo", "super", "gostei", "rapida",
    "dentro", "antes", "boa", "loja", "chega", "demais", "to", "ta",
)

WORD_THEMES = {
    "entrega": "delivery",
    "atraso": "delay", "atrasou": "delay", "atrasado": "delay",
    "demorou": "delay", "demora": "delay", "demorado": "delay",
    "prazo": "deadline",
    "defeito": "defect", "defeituoso": "defect", "quebrado": "broken",
    "estragado": "damaged", "danificado": "damaged",
    "qualidade": "quality", "ruim": "bad", "pessimo": "terrible",
    "horrivel": "terrible",
    "troca": "exchange", "devolucao": "return", "devolver": "return",
    "reembolso": "refund", "dinheiro": "money",
    "cor": "color", "tamanho": "size", "tamanhos": "size",
    "imagem": "image", "foto": "photo", "fotos": "photos",
    "diferente": "different", "descrito": "described", "descricao": "description",
    "anuncio": "advertisement",
    "pagamento": "payment", "pago": "paid", "preco": "price",
    "frete": "shipping_cost", "transporte": "transport",
    "atendimento": "service", "suporte": "support",
    "vendedor": "seller", "loja": "store",
    "caixa": "box", "embalagem": "packaging",
    "funciona": "works", "funcionando": "working",
    "comprei": "bought",
    "entre": "star_prefix",
}

THEME_WORDS = {
    "delivery_speed": (
        "entrega", "atraso", "atrasou", "atrasado", "demorou", "demora", "demorado", "prazo",
    ),
    "product_quality": (
        "defeito", "defeituoso", "quebrado", "estragado", "danificado", "qualidade",
        "ruim", "pessimo", "horrivel",
    ),
    "product_match": (
        "diferente", "descrito", "descricao", "anuncio", "imagem", "foto", "fotos",
        "cor", "tamanho",
    ),
    "service": (
        "troca", "devolucao", "devolver", "reembolso", "dinheiro", "atendimento",
        "suporte", "vendedor", "loja",
    ),
    "packaging": ("caixa", "embalagem"),
    "payment": ("pagamento", "pago", "preco"),
}

DELAY_WORDS = ("atraso", "atrasou", "atrasado", "demorou", "demora", "demorado")

TOPIC_LABEL_WORDS = {
    "🚚 配送延迟": (
        "atraso", "atrasou", "atrasado", "demorou", "demora", "prazo", "correios",
        "transportadora", "entrega", "envio", "enviado", "postagem", "chegando",
    ),
    "🔧 产品质量": (
        "defeito", "defeituoso", "quebrado", "estragado", "danificado", "qualidade",
        "ruim", "pessimo", "horrivel", "amassados", "arranhado", "riscado",
    ),
    "📐 描述不符": (
        "diferente", "descrito", "descricao", "anuncio", "imagem", "foto", "fotos",
        "cor", "tamanho", "tamanhos", "errado", "trocado", "modelo",
    ),
    "📞 售后无响应": (
        "troca", "devolucao", "devolver", "reembolso", "dinheiro", "atendimento",
        "suporte", "vendedor", "resposta", "respondem", "resolver", "solucao",
        "contato", "email", "emails", "mensagem",
    ),
    "📦 缺件/漏发": (
        "faltando", "faltou", "incompleto", "faltaram", "metade", "apenas", "so",
        "veio", "peca", "pecas",
    ),
}

WORD_GROUP_LABELS = ("差评(1-2星)", "好评(4-5星)")
SOURCE_GROUP_LABELS = ("差评-延迟订单", "差评-非延迟订单")
