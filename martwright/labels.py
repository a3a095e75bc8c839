"""Fixed output values. Logic uses integer ids; these texts only name the results."""

# Category stand-ins for orders without a usable category.
MISSING_PRODUCT_CATEGORY = "missing_product_category"
MISSING_TRANSLATION = "missing_translation"
NO_ORDER_ITEMS = "no_order_items"
UNKNOWN = "unknown"

# Delay buckets, days, right-closed; the id is the position.
DELAY_BUCKET_EDGES = (0.0, 3.0, 7.0, 14.0)
DELAY_BUCKETS = ("Нет задержки", "1-3 дня", "4-7 дней", "8-14 дней", "14+ дней")

# Stage that caused a delay; the id is the position.
DELAY_STAGES = ("Поздняя передача продавцом", "Долгая транспортировка", "Оба этапа", "Другое")

# Freight share of the order price, right-closed.
FREIGHT_EDGES = (-0.001, 0.05, 0.10, 0.20, 0.35, 0.50)
FREIGHT_BINS = ("0-5%", "5-10%", "10-20%", "20-35%", "35-50%", "50%+")

# Row labels of the prepared order mart.
BAD_REVIEW, GOOD_REVIEW, NO_REVIEW = "Плохой отзыв", "Не плохой отзыв", "Без отзыва"
DELAYED, NOT_DELAYED = "С задержкой", "Без задержки"
NOT_DELIVERED_GROUP = "Не доставлено"
DELIVERED, NOT_DELIVERED = "Доставлен", "Не доставлен"

# Effect sizes by absolute value, and the direction of a difference.
EFFECT_EDGES = (0.1, 0.3, 0.5)
EFFECT_SIZES = ("незначимый", "слабый", "умеренный", "сильный")
EFFECT_UNDEFINED = "не определена"
# Orders that the seller test takes, with and without those of several sellers.
ANY_SELLER, SINGLE_SELLER = "заказы", "single-seller заказы"
ABOVE_AVERAGE, BELOW_AVERAGE = "выше среднего", "ниже среднего"

# Pieces of the interpretation sentence.
NOT_TESTED = "Тест не проводился"
SIGNIFICANT = "статистически значимо"
NOT_SIGNIFICANT = "статистически незначимо"
INTERPRETATION = "После поправки BH: %s (p_adj=%s); эффект %s (%s=%s)"

# Names of tests and effects.
CHI_SQUARE_TEST = "chi-square test of independence"
RANK_SUM_TEST = "Mann-Whitney U test"
SPEARMAN_TEST = "Spearman correlation"
TREND_TEST = "Cochran-Armitage trend test"
CRAMERS_V = "Cramér's V"
RANK_BISERIAL = "rank-biserial correlation"
SPEARMAN_RHO = "Spearman rho"
BUCKET_RHO = "Spearman rho (корзина vs плохой отзыв)"

# Hypothesis -> (statement, scope, first metric, second metric).
HYPOTHESES = {
    "H1": (
        "H1: доля плохих отзывов зависит от факта задержки доставки",
        "доставленные заказы с отзывом",
        "bad_review_rate_delayed",
        "bad_review_rate_not_delayed",
    ),
    "H2": (
        "H2: оценки заказов с задержкой отличаются от оценок заказов без задержки",
        "доставленные заказы с отзывом",
        "mean_review_delayed",
        "mean_review_not_delayed",
    ),
    "H3": (
        "H3: доля доставки в стоимости заказа связана с оценкой",
        "заказы с отзывом и известной долей доставки",
        "spearman_rho",
        "n_observations",
    ),
    "H4": (
        "H4: категории товаров различаются по доле плохих отзывов",
        "заказы с отзывом, категории с >= 30 заказами",
        "n_categories",
        "min_orders_per_category",
    ),
    "H5": (
        "H5: регионы покупателей различаются по доле задержанных доставок",
        "доставленные заказы, регионы с >= 30 заказами",
        "n_states",
        "min_orders_per_state",
    ),
    "H6": (
        "H6: внутри категории продавцы различаются по доле плохих отзывов",
        "%s с отзывом, фокусная категория %s (>= %s заказов на продавца)",
        "n_sellers",
        "category_bad_review_rate",
    ),
    "H7": (
        "H7: поздняя передача перевозчику (зона продавца) связана с плохим отзывом",
        "заказы с отзывом и известным фактом просрочки отгрузки",
        "bad_review_rate_late_handover",
        "bad_review_rate_on_time_handover",
    ),
    "H8": (
        "H8: вероятность плохого отзыва растёт с длительностью задержки",
        "доставленные заказы с отзывом, по корзинам длительности задержки",
        "bad_review_rate_no_delay",
        "bad_review_rate_14plus",
    ),
}
# Row order of the hypothesis table.
HYPOTHESIS_ORDER = ("H1", "H2", "H3", "H4", "H5", "H7", "H8", "H6")

# Normal quantile for two-sided 95 % intervals.
Z95 = 1.959963984540054

# Cell texts that a CSV load treats as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
