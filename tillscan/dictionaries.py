"""Word lists, dictionaries and formats the results depend on.

Fixed values: everything in this module is given by the task and stated as it is. The
functions of ``tillscan.sources.dictionaries`` turn them, or files of the same shape, into
lookup tables.
"""

from __future__ import annotations

# --- Fixed values: words that end or disqualify a line ---------------------------------
STOP_WORDS = ("subtotal", "total", "recibi", "cambio", "tarjeta", "efectivo")

METADATA_WORDS = (
    "cuit", "direccion", "responsable", "consumidor", "actividad", "fecha", "hora", "nro", "ing.",
    "iva", "cod.", "pv", "tique", "seshia", "orientacion", "transparencia", "fiscal", "regimen",
    "afip", "cliente", "cantidad", "descripcion", "importe", "whatsapp", "ticket", "lunes",
    "sabados", "gracias", "onsumidor",
)

#: Words that mark an adjustment rather than a product.
ADJUSTMENT_WORDS = ("vuelto", "ley 27", "transparencia", "descuento", "recargo", "envio")
ADJUSTMENT_COMPACT = ("ley27",)

#: Names of the delivery app, and words that are no product there.
APP_NAMES = ("pedidosya", "pedidos ya")
APP_PROMOTIONS = ("cambio de peso", "off", "market")
APP_INLINE_STOPS = ("off", "market", "subtotal", "total")

DATE_LABEL = "fecha"
NOT_DATE_LABELS = ("inicio", "actividad")
STORE_LABEL = "supermercado"
DEFAULT_STORE = "Compra sin identificar"
CATEGORY = "Supermercado"
NO_BRAND = "Sin marca"
GENERIC_BRAND = "Generico"
STORE_LINES = 14
FIRST_YEAR = 2015

# --- Fixed values: product names by the words they are recognised by, first match wins ---
PRODUCT_RULES = (
    ("Salchichas", ("salchi", "salchich")),
    ("Galletitas", ("gallet", "gal let", "gal.let", "galleta")),
    ("Pure de tomates", ("pure tom", "pure tomate", "pure de tom")),
    ("Papel higienico", ("papel",)),
    ("Panuelos", ("panue", "panuel")),
    ("Ravioles", ("raviol", "rayiol", "rayioles")),
    ("Limpiador", ("limpi",)),
    ("Gelatina", ("gelleti", "gelletid", "gelat")),
    ("Manteca", ("manteca",)),
    ("Yogur", ("yogur",)),
    ("Azucar", ("azucar",)),
    ("Suavizante", ("suavi",)),
    ("Jabon", ("jabon",)),
    ("Manzanilla", ("manzan", "manzani", "manzanilla")),
    ("Mix de semillas", ("mix de semillas", "semillas")),
    ("Sal", ("sal",)),
    ("Pan multicereal", ("pan multicerea", "pan multicereal", "multicerea")),
    ("Bolsa", ("bolsa",)),
    ("Cebolla", ("cebolla",)),
    ("Agua mineral", ("agua mineral",)),
    ("Papas", ("papas",)),
    ("Harina", ("harina",)),
    ("Leche", ("leche",)),
    ("Queso rallado", ("queso rallado",)),
)
#: The one product that is known by brand and a part of its name.
SPECIAL_PRODUCT = ("punta del agua", "cr", "Queso cremoso")

# --- Fixed values: brands, in the order that settles ties --------------------------------
BRANDS = (
    "Actron", "Agua de la Loma", "Alicante", "Arcor", "Ayudin", "Cañuelas", "Celosas", "Coca",
    "Cumana", "Curitas", "De preal", "Dermaglos", "Don Ancla", "Don Satur", "Dove", "El Sol",
    "Elegante", "Formis", "Frutigram", "Generico", "Granix", "Guaymallen", "Hellmann's",
    "Heroe", "Higienol", "Hileret", "Imperial", "Inca", "Jorgito", "Knoii", "La Campagnola",
    "La Francia", "La Paulina", "La Providencia", "La Serenisima", "Lia", "Lucchetti",
    "Lucchtti", "Luchetti", "Lux", "Lysoform", "Mani", "Manty", "McCain", "Molto", "Morenita",
    "Morixe", "Nisin", "Nivea", "Paps", "Parnor", "Paty", "Pitusas", "Procenex",
    "Punta del agua", "Querubin", "Sancor", "Sertal", "Sierra De Los Padres", "Tarieta",
    "Tregar", "Unión Ganadera", "Vocación",
)
#: Further spellings of a brand, by its normal form.
BRAND_SPELLINGS = {
    "la providencia": ("la providecia", "la providedcia"),
    "frutigram": ("frutigran",),
    "union ganadera": ("union",),
}
#: Parts of a brand name that may be written otherwise.
BRAND_VARIANTS = ((" del ", " de "), (" de la ", " "), ("'", ""))
IGNORED_BRANDS = (
    "almacen", "generico", "sin marca", "supermercado", "zou wenguo", "onsumidorley",
    "consumidor", "bolsa", "bahia", "levadura", "s p coctel", "su a",
)
IGNORED_BRAND_PART = "seshia"

# --- Fixed values: stores by the names they are recognised by, first match wins ----------
STORE_FIRST = (
    ("zou wenguo", "Los Tres Corazones"),
    ("zou wenguc", "Los Tres Corazones"),
    ("los tres corazones", "Los Tres Corazones"),
    ("tres corazones", "Los Tres Corazones"),
)
STORES = (
    ("zou wenguo", "Los Tres Corazones"),
    ("zou wenguc", "Los Tres Corazones"),
    ("zouwenguo", "Los Tres Corazones"),
    ("zouwenguc", "Los Tres Corazones"),
    ("zou wengulo", "Los Tres Corazones"),
    ("zou wenguio", "Los Tres Corazones"),
    ("z0u wenguo", "Los Tres Corazones"),
    ("zou wenguo supermercado", "Los Tres Corazones"),
    ("los tres corazones", "Los Tres Corazones"),
    ("lostrescorazones", "Los Tres Corazones"),
    ("los trescorazones", "Los Tres Corazones"),
    ("tienda filipa", "Tienda Filipa"),
    ("tienda filipa s r l", "Tienda Filipa"),
)

# --- Fixed values: words that score OCR results -------------------------------------------
OCR_HEADER_TOKENS = ("fecha", "total", "subtotal", "supermercado", "corazones", "consumidor")
OCR_PRODUCT_TOKENS = (
    "serenisima", "elegante", "higienol", "frutigran", "union", "vocacion", "papel", "salchich",
)
OCR_NOT_ITEM = ("fecha", "hora", "total", "subtotal", "cuit", "direccion", "recibi", "vuelto")

# --- Fixed values: the export ---------------------------------------------------------------
EXPORT_HEADER = (
    "Descripción", "Marca", "Lugar de compra", "Categoria", "Cantidad", "Precio unitario", "Fecha",
)
EMPTY_UPLOAD_MESSAGE = "Subi una imagen o PDF de la factura."
EMPTY_TEXT_MESSAGE = "PaddleOCR no detecto texto util en la factura."
OCR_ERROR_PREFIX = "PaddleOCR fallo: "

# --- Fixed values: formats, as patterns -----------------------------------------------------
DATE = r"(\d{1,2}\s*[/-]\s*\d{1,2}(?:\s*[/-]\s*\d{2,4})?)"
AMOUNT = r"(?:\$\s*\d+[\.,]\d{5}|\$\s*\d+(?:[\.,]\d{3})*(?:[\.,]\d{2})?|\d+(?:[\.,]\d{3})*[\.,]\d{2})(?!\d)"
PRICE_AT_END = r"(.+?)\s+(\d+(?:[\.,]\d{3})*[\.,]\d{2})$"
SPECIAL_LINE = r"(?i)^.*?(PUNTA\s+DE\s+AGUA\s+CR\s*\*?\s*1UN)\s+(\d+(?:[\.,]\d{3})*[\.,]\d{2}).*$"
PRICE_ONLY = r"^(\d+(?:[\.,]\d{3})*[\.,]\d{2})$"
TIMES_AMOUNT = r"(?i)\b(\d+)\s*[xX]\s*(\d+(?:[\.,]\d{3})*[\.,]\d{2})\b"
TIMES_COUNT = r"(?i)\bx\s*(\d{1,2})\b"
VERSION_LINE = r"^v ?\d+(?: \d+)?$"
WEIGHT_LINE = r"^[0-9 kg]+$"
COUNT_BEFORE = r"(?i)^\s*\d+(?:[\.,]\d+)?\s*x\s*"
COUNT_AFTER = r"(?i)\s+\d+(?:[\.,]\d+)?\s*x\s*$"
LONG_DECIMALS = r"\b\d+[\.,]\d{3,4}\b"
UNIT_PRICE_LABEL = r"(?i)\bprecio\s+unit\b"
LEADING_NUMBER = r"(?i)^\s*\d+\s+"
UNITS = r"(?i)\b\d+x\b"
GRAMS_AND_KILOGRAMS = r"(?i)\b\d+g?\s*\d+(?:[\.,]\d+)?\s*kg\b"
ONLY_KILOGRAMS = r"(?i)\b\d+(?:[\.,]\d+)?\s*kg\b"
NAMED_UNITS = r"(?i)\s+(\d+)x\s*$"
TRAILING_UNITS = r"(?i)\b(\d+)x\s*$"
KILOGRAMS = r"(?i)(\d+(?:[\.,]\d+)?)\s*kg\b"
GLUED_SIZE = r"(?i)([a-z])x(\d)"
TRAILING_TAX_RATE = r"(?i)\s*\(?\b21\)?\s*$"
SPECS = r"(?i)\b(?:x\d+[a-z]*|\d+(?:[a-z]+)?)\b"

# --- Images and retries (fixed values) -------------------------------------------------------

#: Weights of red, green and blue, in 1/65536 (ITU-R 601-2).
GRAY_RED, GRAY_GREEN, GRAY_BLUE = 19595, 38470, 7471
CONTRAST_SCALE, CONTRAST_OFFSET, BORDER = 1.28, 14, 16
PAPER_LEVEL, PAPER_SHARE, PAPER_LINES, PAPER_MARGIN = 165, 0.45, 40, 25
PAPER_WIDTH, PAPER_HEIGHT = 0.22, 0.35
LONGEST_SIDE = 2200
RETRY_STEP, RETRY_MOST = 1500, 4000
#: Renderings of a page: factors, levels and longest sides; turns in the order in which they are tried.
CONTRAST_FACTOR, SHARPNESS_FACTOR, DARK_LEVEL, LIGHT_LEVEL = 2.3, 2.0, 172, 150
VARIANT_SIDE, ENLARGED_SIDE, SMALL_SIDE = 1400, 1800, 900
VARIANT_TURNS = ((0, "original"), (90, "rot90"), (270, "rot270"), (180, "rot180"))
VARIANT_NAMES = ("cropped", "gray", "enhanced", "threshold", "denoised", "light-threshold", "small", "small-gray")
