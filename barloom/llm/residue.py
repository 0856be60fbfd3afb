"""Template residue, filler and error-page text in place of content.

A multi-pattern automaton marks every known phrase of a text in one pass; the text is residue when
the marked part is most of it.  News that merely mentions such a phrase is mostly unmarked.  Generated
filler is known by its form: beside standard filler words, made-up words with Latin endings count too.
Slots of story templates are a case wherever they stand, and have no closed list of words, so their
notations are matched on their own and not by the automaton.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.session import spread

#: Share of a text's characters (numbers and identifiers aside) that phrases must cover.
COVERAGE = 0.75

# Phrases of servers, sites and publishing systems, lower case, words separated by one
# blank. Each alone is evidence.
PHRASES = {
    "filler": """
        lorem|ipsum|dolor|sit|amet|consectetur|adipiscing|elit|sed|varius|tempus|porta|nulla|quam|mollis|vitae|magna|tincidunt|vestibulum
        asdf|asdfasdf|qwerty|qwertz|azerty|foo|bar|baz|blah|bla|xxx|abc|test test|testing testing|hjkl|jkl|dfgh
        blindtext|blindtext zur ansicht|platzhaltertext|dies ist ein blindtext|texte factice pour la mise en page|texte factice|texte de remplissage|faux texte
        texto de relleno|texto de prueba|texto de ejemplo|placeholder text for layout|placeholder text|placeholder|placeholder only|dummy paragraph|dummy text|sample text|filler text|test text
        eiusmod|tempor|incididunt|labore|dolore|aliqua|enim|minim|veniam|quis|nostrud|exercitation|ullamco|laboris|nisi|aliquip|commodo|consequat|duis|aute|irure|reprehenderit|voluptate|velit|esse|cillum|fugiat|pariatur|excepteur|sint|occaecat|cupidatat|proident|sunt|culpa|officia|deserunt|mollit|anim|laborum
        perspiciatis|unde|omnis|iste|natus|voluptatem|accusantium|doloremque|laudantium|totam|rem|aperiam|eaque|ipsa|quae|illo|inventore|veritatis|quasi|architecto|beatae|dicta|explicabo|nemo|ipsam|quia|voluptas|aspernatur|odit|fugit|consequuntur|magni|dolores|eos|ratione|sequi|nesciunt|neque|porro|quisquam|dolorem|adipisci|numquam|eius|modi|tempora|magnam|aliquam|quaerat|minima|nostrum|exercitationem|ullam|corporis|suscipit|laboriosam|aliquid|commodi|consequatur|autem|vel|eum|iure|molestiae|illum|quo
        vero|accusamus|iusto|odio|dignissimos|ducimus|blanditiis|praesentium|voluptatum|deleniti|atque|corrupti|quos|quas|molestias|excepturi|occaecati|cupiditate|provident|similique|mollitia|animi|dolorum|fuga|harum|quidem|rerum|facilis|expedita|distinctio|nam|libero|tempore|cum|soluta|nobis|eligendi|optio|cumque|impedit|quod|maxime|placeat|facere|possimus|assumenda|repellendus|temporibus|quibusdam|officiis|debitis|necessitatibus|saepe|eveniet|voluptates|repudiandae|recusandae|itaque|earum|tenetur|sapiente|delectus|reiciendis|voluptatibus|maiores|perferendis|doloribus|asperiores|repellat
        accumsan|aenean|aliquet|aptent|arcu|auctor|augue|bibendum|blandit|condimentum|congue|consectetuer|conubia|convallis|cras|cubilia|curabitur|curae|cursus|dapibus|diam|dictum|dictumst|dignissim|donec|efficitur|egestas|eget|eleifend|elementum|erat|eros|euismod|facilisi|facilisis|fames|faucibus|felis|fermentum|feugiat|finibus|fringilla|fusce|gravida|habitant|habitasse|hendrerit|himenaeos|iaculis|imperdiet|inceptos|interdum|justo|lacinia|lacus|laoreet|lectus|libero|ligula|litora|lobortis|luctus|maecenas|malesuada|massa|mattis|mauris|maximus|metus|montes|morbi|mus|nascetur|natoque|netus|nibh|nisl|nostra|nullam|nunc|odio|orci|ornare|parturient|pellentesque|penatibus|pharetra|phasellus|placerat|platea|posuere|potenti|praesent|pretium|primis|proin|pulvinar|purus|quisque|rhoncus|ridiculus|risus|rutrum|sagittis|sapien|scelerisque|sem|semper|senectus|sociosqu|sodales|sollicitudin|suscipit|suspendisse|taciti|tellus|torquent|tortor|tristique|turpis|ullamcorper|ultrices|ultricies|urna|varius|vehicula|venenatis|vestibulum|vivamus|viverra|volutpat|vulputate
        the quick brown fox jumps over the lazy dog|quick brown fox|body copy goes here|article text to follow here|article text to follow|your headline here|your text here|text goes here|headline goes here|content goes here|summary goes here|story goes here
        enter summary text|enter headline text|enter text here|type your article here|type your text here|type here|insert text here|add text here|add text|no title yet|untitled document|untitled
        draft only|content to be added|content coming soon|coming soon|to be written|text to come|copy to come|story to come
        this is a dummy article|this is a test story|this is a sample record|this is a test|this is a test article|this is only a test|this is a placeholder|this is a sample|this is a dummy|this is a dummy record|this is a dummy story|this is a sample article|this is a sample story|this is a test record
        please ignore|please remove before release|please replace before release|remove before publishing|do not publish|not for publication
        рыбный текст|текст заполнитель|пример текста|тестовая статья|тестовая запись|tekst zastępczy|przykładowy tekst|testo segnaposto|testo di esempio|texto fictício|texto de exemplo|opvultekst|voorbeeldtekst|platshållartext|exempeltext|örnek metin|deneme yazısı|κείμενο δείγμα|نص تجريبي|هذا النص هو مثال|示例文本|测试文章|占位文本|測試文章|ダミーテキスト|サンプルテキスト|テスト投稿|샘플 텍스트|테스트 글|더미 텍스트
    """,
    "error": """
        not found|page not found|file not found|forbidden|unauthorized|bad request|bad gateway|gateway timeout|gateway time out|service unavailable|service temporarily unavailable|internal server error|too many requests|gone|method not allowed|request timeout|proxy error|connection timed out|connection refused
        http error|server error|application error|runtime error|fatal error|unexpected error|an error occurred|an error has occurred|an unexpected error occurred|database error|error establishing a database connection
        could not connect to|could not connect to database|unable to connect|host unreachable|upstream request timeout|upstream connect error|no healthy upstream|stack trace|segmentation fault|traceback most recent call last
        the page you requested could not be found|the page you are looking for could not be found|the requested page could not be found|this page could not be found|this page does not exist|page does not exist|it may have been moved or deleted|may have been moved or deleted|this story is no longer here|this page is no longer here|this article is no longer available|this story is no longer available|go back to the front page|go back to the home page|try a search|return to the home page|the requested url was not found on this server
        we re sorry something went wrong on our end|something went wrong on our end|something went wrong|we re sorry|sorry|oops|please try again later|try again later|try again in
        down for maintenance|site under maintenance|under maintenance|scheduled maintenance|we will be back at|we will be back soon|we ll be back soon|be right back
        the requested url|was not found on this server|the requested url was not found on the server|if you entered the url manually please check your spelling and try again|the requested resource was not found on this server|the requested resource could not be found|additionally a error was encountered while trying to use an errordocument to handle the request|additionally a not found error was encountered while trying to use an errordocument to handle the request|that s an error|that s all we know
        the server encountered an internal error and was unable to complete your request|the server encountered an internal error or misconfiguration and was unable to complete your request|either the server is overloaded or there is an error in the application|please contact the server administrator at|please contact the server administrator|please contact the administrator|to inform them of the time this error occurred and the actions you performed just before this error|more information about this error may be available in the server error log|a server error occurred|the method is not allowed for the requested url|the requested method is not allowed for the url|your browser sent a request that this server could not understand|the browser or proxy sent a request that this server could not understand|the server is temporarily unable to service your request due to maintenance downtime or capacity problems
        the proxy server received an invalid response from an upstream server|the proxy server could not handle the request|error reading from remote server|the gateway did not receive a timely response from the upstream server or application|the document has moved here|moved permanently|request entity too large|uri too long|not acceptable|service is unavailable|the service is unavailable|no server is available to handle this request|the server returned an invalid or incomplete response|the server didn t respond in time|backend fetch failed|guru meditation|error the requested url could not be retrieved|the requested url could not be retrieved|the following error was encountered while trying to retrieve the url|your cache administrator is
        the page you are looking for is currently unavailable|if you are the system administrator of this resource then you should check the error log for details|faithfully yours nginx|welcome to nginx|if you see this page the nginx web server is successfully installed and working further configuration is required|for online documentation and support please refer to|commercial support is available at|thank you for using nginx
        file or directory not found|the resource you are looking for might have been removed had its name changed or is temporarily unavailable|the resource you are looking for has been removed had its name changed or is temporarily unavailable|the resource cannot be found|there is a problem with the resource you are looking for and it cannot be displayed|you do not have permission to view this directory or page using the credentials that you supplied|server error in application|an application error occurred on the server|the current custom error settings for this application prevent the details of the application error from being viewed remotely for security reasons
        http status|type status report|type exception report|the origin server did not find a current representation for the target resource or is not willing to disclose that one exists|the server encountered an unexpected condition that prevented it from fulfilling the request|whitelabel error page|this application has no explicit mapping for|so you are seeing this as a fallback|there was an unexpected error|no message available|cannot get|missing authentication token
        application error a client side exception has occurred|see the browser console for more information|an error occurred in the application and your page could not be served|if you are the application owner check your logs for details|if you are the application owner check the logs for more information|you can do this from the heroku cli with the command heroku logs tail|there isn t a github pages site here|the site configured at this address does not contain the requested file|the deployment could not be found on vercel|this deployment cannot be found
        the page you were looking for doesn t exist|you may have mistyped the address or the page may have moved|we re sorry but something went wrong|whoops looks like something went wrong|page expired|there has been a critical error on this website|please check your site admin email inbox for instructions|learn more about troubleshooting wordpress|briefly unavailable for scheduled maintenance|check back in a minute|that page can t be found|it looks like nothing was found at this location|maybe try a search|maybe try one of the links below or a search|the website encountered an unexpected error|we can t find the page you re looking for|the page you re looking for can t be found|the page you re looking for doesn t exist|the page you requested was not found|sorry the page you are looking for could not be found|the page you are looking for doesn t exist|the page you are looking for does not exist
        this site can t be reached|this page isn t working|this page isn t available|is currently unable to handle this request|unexpectedly closed the connection|refused to connect|took too long to respond|didn t send any data|checking the connection|checking the proxy and the firewall|check if there is a typo in|s server ip address could not be found|server ip address could not be found|err connection refused|err connection timed out|err connection reset|err name not resolved|err empty response|err too many redirects|dns probe finished nxdomain|redirected you too many times|try clearing your cookies|your connection is not private|secure connection failed|no internet|the connection has timed out|the connection was reset|firefox can t establish a connection to the server at|can t establish a connection to the server at|is taking too long to respond|we re having trouble finding that site|we can t connect to the server at|safari can t open the page|because the server unexpectedly dropped the connection|the site could be temporarily unavailable or too busy|connection reset by peer|name or service not known|no route to host
        the request could not be satisfied|we can t connect to the server for this app or website at this time|there might be too much traffic or a configuration error|try again later or contact the app or website owner|if you provide content to customers through cloudfront you can find steps to troubleshoot and help prevent this error by reviewing the cloudfront documentation|generated by cloudfront|web server is down|web server is returning an unknown error|origin is unreachable|origin dns error|a timeout occurred|the web server is not returning a connection|the web server reported a bad gateway error
        seite nicht gefunden|die seite wurde nicht gefunden|diese seite existiert nicht|interner serverfehler|zugriff verweigert|zugriff nicht erlaubt|dienst nicht verfügbar|es ist ein fehler aufgetreten|wartungsarbeiten|page introuvable|cette page n existe pas|accès refusé|accès interdit|erreur interne du serveur|erreur du serveur|service indisponible|une erreur est survenue|site en maintenance|página no encontrada|pagina no encontrada|esta página no existe|acceso denegado|acceso prohibido|error interno del servidor|servicio no disponible|se ha producido un error|sitio en mantenimiento|pagina non trovata|accesso negato|errore del server|página não encontrada|acesso negado|pagina niet gevonden|toegang geweigerd|errore interno del server|servizio non disponibile|si è verificato un errore|sito in manutenzione|erro interno do servidor|serviço indisponível|ocorreu um erro|site em manutenção|interne serverfout|dienst niet beschikbaar|er is een fout opgetreden|de pagina bestaat niet|onderhoud
        sidan hittades inte|sidan kunde inte hittas|internt serverfel|ett fel har inträffat|åtkomst nekad|siden blev ikke fundet|siden ble ikke funnet|intern serverfejl|intern serverfeil|der opstod en fejl|det oppstod en feil|sivua ei löytynyt|palvelimen sisäinen virhe|strona nie została znaleziona|nie znaleziono strony|wewnętrzny błąd serwera|usługa niedostępna|wystąpił błąd|przerwa techniczna|stránka nenalezena|stránka nebyla nalezena|chyba serveru|došlo k chybě|az oldal nem található|szerverhiba|hiba történt|pagina nu a fost găsită|eroare internă a serverului|a apărut o eroare
        страница не найдена|страница не существует|запрашиваемая страница не найдена|файл не найден|ошибка сервера|внутренняя ошибка сервера|сервис недоступен|сервис временно недоступен|сайт временно недоступен|произошла ошибка|что то пошло не так|попробуйте позже|повторите попытку позже|технические работы|сайт на реконструкции|сторінку не знайдено|внутрішня помилка сервера|сталася помилка|страницата не е намерена|страница није пронађена
        sayfa bulunamadı|aradığınız sayfa bulunamadı|sunucu hatası|hizmet kullanılamıyor|bir hata oluştu|bakım çalışması|η σελίδα δεν βρέθηκε|σφάλμα διακομιστή|παρουσιάστηκε σφάλμα|الصفحة غير موجودة|لم يتم العثور على الصفحة|خطأ في الخادم|خطأ داخلي في الخادم|الخدمة غير متوفرة|حدث خطأ|הדף לא נמצא|שגיאת שרת|אירעה שגיאה|صفحه پیدا نشد|خطای سرور|पृष्ठ नहीं मिला|सर्वर त्रुटि|trang không tồn tại|không tìm thấy trang|lỗi máy chủ|halaman tidak ditemukan|kesalahan server|terjadi kesalahan|ไม่พบหน้า|ไม่พบหน้าที่คุณต้องการ
        页面不存在|页面未找到|找不到页面|您访问的页面不存在|您要查看的页面不存在|抱歉|服务器错误|服务器内部错误|内部服务器错误|服务不可用|网关错误|网关超时|网络错误|系统繁忙|系统维护中|网站维护中|请稍后再试|请稍后重试|出错了|頁面不存在|找不到網頁|找不到頁面|伺服器錯誤|內部伺服器錯誤|服務暫時無法使用|系統維護中|請稍後再試|ページが見つかりません|ページが見つかりませんでした|お探しのページは見つかりませんでした|お探しのページが見つかりません|サーバーエラー|サーバーエラーが発生しました|内部サーバーエラー|サービスは利用できません|サービス利用不可|エラーが発生しました|メンテナンス中|メンテナンス中です|ただいまメンテナンス中です|しばらくしてからもう一度お試しください|申し訳ございません|페이지를 찾을 수 없습니다|요청하신 페이지를 찾을 수 없습니다|존재하지 않는 페이지입니다|서버 오류|내부 서버 오류|서비스를 사용할 수 없습니다|오류가 발생했습니다|점검 중입니다|시스템 점검 중|잠시 후 다시 시도해 주세요|잠시 후 다시 시도해 주십시오
    """,
    "access": """
        access denied|access is denied|access to this page has been denied|permission denied|you don t have permission to view this article|you don t have permission to view this page|you do not have permission to view this page|you don t have permission to access|you are not authorized to view this page|this content is not available in your region|this content is not available in your country
        too many requests from your network|unusual traffic from your network|complete the check below to prove you are not a robot|prove you are not a robot|verify you are human|are you a robot|checking your browser before accessing|complete the captcha|please complete the security check
        your session has expired|session expired|your session has timed out|please sign in again to continue reading|please sign in again|please sign in to continue|sign in to continue reading|sign in to continue|please log in to continue|log in to continue reading|subscribe to continue reading|subscribers only|your request has been blocked|request blocked|you have been blocked|your ip address has been blocked
        you don t have permission to access this resource|you don t have permission to access this resource on this server|you don t have permission to access on this server|you don t have permission to access the requested resource|you do not have permission to access this resource|server unable to read htaccess file denying access to be safe|attention required cloudflare|attention required|sorry you have been blocked|you are unable to access|why have i been blocked|this website is using a security service to protect itself from online attacks|this website is using a security service to protect itself from malicious bots|the action you just performed triggered the security solution|there are several actions that could trigger this block including submitting a certain word or phrase a sql command or malformed data|what can i do to resolve this|you can email the site owner to let them know you were blocked|please include what you were doing when this page came up and the cloudflare ray id found at the bottom of this page|performance security by cloudflare|ddos protection by cloudflare|has banned your access based on your browser s signature|has banned your ip address
        just a moment|checking if the site connection is secure|needs to review the security of your connection before proceeding|verifying you are human|verify you are human by completing the action below|this may take a few seconds|this process is automatic|your browser will redirect to your requested content shortly|please allow up to seconds|please wait while your request is being verified|pardon our interruption|press hold to confirm you are a human and not a bot|authorization required|authentication required|this server could not verify that you are authorized to access the document requested|authentication credentials were not provided|proxy authentication required
        ihre sitzung ist abgelaufen|bitte melden sie sich erneut an|bitte melden sie sich an|votre session a expiré|veuillez vous reconnecter|veuillez vous connecter|su sesión ha caducado|su sesión ha expirado|inicie sesión de nuevo|inicie sesión para continuar|sessione scaduta|accedi per continuare|accesso non consentito|sua sessão expirou|faça login para continuar|je sessie is verlopen|log in om verder te lezen|din session har gått ut|logga in för att fortsätta|sesja wygasła|zaloguj się aby kontynuować|odmowa dostępu|brak dostępu|přístup odepřen|přístup zamítnut|hozzáférés megtagadva|acces interzis
        доступ запрещён|доступ запрещен|доступ ограничен|сессия истекла|время сессии истекло|войдите чтобы продолжить|авторизуйтесь|подтвердите что вы не робот|проверка браузера|доступ заборонено|erişim engellendi|erişim reddedildi|oturumunuzun süresi doldu|devam etmek için giriş yapın|δεν επιτρέπεται η πρόσβαση|απαγορεύεται η πρόσβαση|تم رفض الوصول|الوصول مرفوض|انتهت الجلسة|הגישה נדחתה|अभिगम अस्वीकृत|truy cập bị từ chối|akses ditolak
        访问被拒绝|禁止访问|没有权限|您没有权限访问此页面|拒绝访问|会话已过期|登录已过期|请登录|请先登录|请重新登录|请登录后继续|请完成验证|请输入验证码|存取被拒|拒絕存取|請先登入|請重新登入|アクセスが拒否されました|アクセス拒否|アクセスできません|アクセス権がありません|セッションの有効期限が切れました|ログインしてください|再度ログインしてください|접근이 거부되었습니다|액세스 거부|접근 권한이 없습니다|세션이 만료되었습니다|로그인이 필요합니다|로그인해 주세요|다시 로그인해 주세요
    """,
    "script": """
        please enable javascript|enable javascript|you need to enable javascript|javascript is required|javascript is disabled|javascript must be enabled|javascript required|javascript is not enabled|your browser has scripting disabled|your browser does not support javascript|your browser has javascript disabled|this site requires scripts to be turned on|this site requires javascript|this page requires javascript|this app requires javascript|turn on cookies and scripts|turn on cookies|turn on scripts|turn on javascript|please turn on javascript|please enable cookies|enable cookies|please enable scripts|please turn on scripts|enable scripts|scripts are disabled|scripts must be turned on
        enable javascript and cookies to continue|please enable js and disable any ad blocker|we re sorry but this app doesn t work properly without javascript enabled|doesn t work properly without javascript enabled please enable it to continue|please enable it to continue|javascript is not available|we ve detected that javascript is disabled in this browser|please enable javascript or switch to a supported browser|this site requires javascript to be enabled|this website requires javascript
        bitte aktivieren sie javascript|bitte javascript aktivieren|javascript ist deaktiviert|aktivieren sie javascript|javascript wird benötigt|veuillez activer javascript|merci d activer javascript|activez javascript|javascript est désactivé|javascript est requis|por favor active javascript|por favor habilite javascript|habilite javascript|active javascript|activa javascript|javascript está desactivado|se requiere javascript|abilita javascript|attiva javascript|ative o javascript|schakel javascript in|javascript è disabilitato|javascript está desativado|habilite o javascript|javascript is uitgeschakeld|aktivera javascript|aktiver javascript|javascript är avstängt|ota javascript käyttöön|włącz javascript|włącz obsługę javascript|javascript jest wyłączony|povolte javascript|zapněte javascript|engedélyezze a javascriptet|activați javascript
        включите javascript|пожалуйста включите javascript|javascript отключен|javascript отключён|необходимо включить javascript|увімкніть javascript|javascript i etkinleştirin|lütfen javascript i etkinleştirin|javascript devre dışı|ενεργοποιήστε τη javascript|ενεργοποιήστε το javascript|يرجى تفعيل javascript|يرجى تمكين javascript|قم بتفعيل javascript|יש להפעיל javascript|कृपया javascript सक्षम करें|vui lòng bật javascript|aktifkan javascript|โปรดเปิดใช้งาน javascript
        请启用javascript|请启用 javascript|请开启javascript|请开启 javascript|请打开javascript|您的浏览器不支持javascript|您的浏览器未启用javascript|javascript 已禁用|需要启用 javascript|請啟用javascript|請啟用 javascript|請開啟 javascript|javascriptを有効にしてください|javascript を有効にしてください|javascriptが無効です|javascript が無効になっています|javascriptが有効になっていません|お使いのブラウザは javascript に対応していません|javascript를 활성화해 주세요|javascript를 사용하도록 설정하십시오|자바스크립트를 활성화해 주세요|자바스크립트를 켜 주세요
    """,
}

# Words that accompany such phrases but are no evidence by themselves.
COMPANIONS = """
    used to|check|verify|fill|test|layout|feed|before release|before publishing|before publication|before launch|please|remove|replace|overwrite|delete|ignore|and|or|the|this|a
    store|article store|database|backend|upstream|cache|host|service|article|record|front page|home page|refresh|reload|then|search|try|go back to|return to
    ошибка|код ошибки|и|обновите страницу|пожалуйста|чтобы продолжить|hata|błąd|proszę|hiba|eroare|σφάλμα|خطأ|错误|错误代码|以继续|继续访问|刷新页面|返回首页|錯誤|返回首頁|エラー|コード|ページを更新してください|トップページへ戻る|오류|오류 코드|새로고침|홈으로
    error|errors|fehler|erreur|código|codigo|errore|erro|code|status|path|story|reference|ref|incident|ray|request|id|words|word|line|on line|ms|after|minutes|seconds|true|false|message|http|url|server|page
    and reload|to view this page|to run this app|in order to continue|to continue|then refresh the story|then refresh the page|and refresh the page|to use this app|to use this site|to read this article|to see this page|or try a search|to continue reading|in your browser|and try again|please
    um fortzufahren|pour continuer|para continuar|in ihrem browser|dans votre navigateur|en su navegador
    html|head|title|body|what happened|description|type|reason|generated|by|on this server|the server at|the owner of this website|your ip|ubuntu|debian|centos|red hat|win|unix|openssl|server at|port|apache|apache server|apache tomcat|nginx|openresty|tengine|lighttpd|litespeed|caddy|gunicorn|werkzeug|varnish|varnish cache server|xid|squid|haproxy|envoy|traefik|microsoft iis|iis|microsoft azure application gateway|cloudflare|cloudflare ray id|ray id|cloudfront|akamai|akamaighost|awselb|heroku|vercel|netlify|jetty|kestrel|cowboy|host id|request id|reference
"""

# Words that only filler text has; they make a text filler, other Latin only covers it.
STRONG = frozenset("lorem ipsum amet consectetur adipiscing eiusmod incididunt tincidunt vestibulum pellentesque perspiciatis consectetuer".split())
# Endings of Latin words. Generators of filler make up words with them; they count only beside filler.
LATIN = re.compile(r"[a-z]{2,}(?:um|us|is|it|et|am|em|or|ur|at|unt|ent|ae|as|os|que)")

# The particles of filler text; other languages use them too, so they count only beside filler.
PARTICLES = "a ab ac ad alias ante at aut class dis do e ea est et eu ex hac hic id in integer leo mi minus nec nihil non per qui se si sub te tu ut".split()

NAME = r"[A-Za-z][A-Za-z0-9]*(?:[_.-][A-Za-z0-9]+)*"
# The notations of unfilled slots.
SLOTS = re.compile(
    "|".join(
        (
            rf"\{{\{{\{{?\s*{NAME}(?:\s*\|\s*\w+)?\s*\}}?\}}\}}",
            rf"[$#]?\{{\s*(?:\d+:)?{NAME}\s*\}}",
            r"\{\d+(?::[^{}\s]*)?\}",
            rf"%\({NAME}\)[sdfr]",
            rf"%{NAME}%",
            rf"<%[=-]?\s*{NAME}\s*-?%>",
            rf"<<\s*{NAME}\s*>>",
            rf"«\s*{NAME}\s*»",
            rf"\[\[\s*{NAME}\s*\]\]",
            rf"@@\s*{NAME}\s*@@",
            rf"(?<![A-Za-z0-9])__{NAME}__(?![A-Za-z0-9])",
            rf"##\s*{NAME}\s*##",
            rf"\[\s*(?i:insert|enter|add)\s+(?:the\s+|a\s+)?{NAME}(?:\s+{NAME}){{0,3}}\s*\]",
            rf"\[\s*(?:{NAME}\s+){{0,3}}(?:TBD|TBC|TBA|TK|tbd|tbc|tba|tk)\s*\]",
            r"\[\s*(?:X{2,}|x{2,}|_{2,}|\.{3}|…|\?{1,3}|#+|•+)\s*\]",
            r"[$€£¥]\s?(?:X+(?:[.,]X+)*|_{2,}|#+(?:[.,]#+)*|\?{2,})(?![A-Za-z0-9-])",
            r"\bQ(?:[?#X]|_+)(?![A-Za-z0-9-])|\b(?:19|20)(?:XX|__|\?\?|##)(?![A-Za-z0-9-])",
            r"(?<![A-Za-z0-9$#-])(?:X+[.,]X+|XX+|#+[.,]#+|##+|_{3,}|\?{2,})(?=\s?(?:%|percent|per cent|million|billion|thousand)(?![A-Za-z]))",
        )
    )
)
TAGS = re.compile(r"</?(?:html|head|title|body|meta|h[1-6]|p|div|span|center|hr|br|b|i|strong|em|a|ul|li|pre|noscript|script|style)\b[^<>]*>|<!doctype[^<>]*>|<!--.*?-->", re.I | re.S)
#: Words; scripts without blanks between words are cut into characters, so a phrase is found anywhere.
WORD = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0e7f]|(?:(?![\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0e7f])[\w\u0900-\u097f](?<!_))+")
PLAIN = re.compile(r"[a-z0-9]+")  # the same on ASCII texts
# Addresses, paths and hosts that servers insert into their phrases.
HOST = r"[\w-]+(?:\.[\w-]+)+(?::\d+)?"
PLACES = re.compile(
    rf"\bhttps?://[^\s\"'<>]+|(?<![^\s\"'(=:])/[\w.~%+-]+(?:/[\w.~%+-]*)*/?(?:\?[^\s\"'<>]*)?|\b\w[\w.+-]*@(?:{HOST}|localhost)"
    rf"|(?:(?<=\bserver at )|(?<=\bconnect to )|(?<=\baccess )|(?<=\btypo in ))(?:{HOST}|localhost)"
    rf"|\b{HOST}(?=\s+(?:refused to connect|took too long to|unexpectedly closed|didn[’']t send any|is currently unable to|redirected you too|needs to review|has banned|is taking too long)|[’']s server IP)",
    re.I,
)
FREE = re.compile(r"\d+|(?=[a-f]*\d)[0-9a-f]{4,}|[a-f]{8,}|0x[0-9a-f]+|\d+[a-z]{1,2}")


@functools.cache
def automaton():
    """One automaton over all phrases, each between blanks; its value is (length, kind)."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for kind, phrases in {"companion": COMPANIONS, **PHRASES}.items():
        for phrase in re.split(r"[|\n]", phrases):
            if phrase := " ".join(WORD.findall(phrase)):
                machine.add_word(f" {phrase} ", (len(phrase), kind))
    for particle in PARTICLES:
        if f" {particle} " not in machine:
            machine.add_word(f" {particle} ", (len(particle), "particle"))
    machine.make_automaton()
    return machine


@functools.cache
def filler_words() -> frozenset[str]:
    return frozenset(p.strip() for p in re.split(r"[|\n]", PHRASES["filler"]) if p.strip() and " " not in p.strip())


def judge(text: str, coverage: float = COVERAGE) -> tuple[str | None, float]:
    """The kind of residue of a text (None: content) and the covered share."""
    if SLOTS.search(text):
        return "slot", 1.0
    bare = PLACES.sub(" ", TAGS.sub(" ", text) if "<" in text else text).lower()
    tokens = [w for w in (PLAIN if bare.isascii() else WORD).findall(bare) if not FREE.fullmatch(w)]
    if not tokens:
        return None, 0.0
    line = f" {' '.join(tokens)} "
    marked, kinds, hits = bytearray(len(line)), {}, list(automaton().iter(line))
    filler = any(kind == "filler" for _, (_, kind) in hits)
    known = [w for w in tokens if w in filler_words()] if filler else []
    if len(STRONG.intersection(known)) >= 2 or len(set(known)) >= 4 and 3 * len(known) >= len(tokens):
        at = 1
        for word in tokens:  # made-up Latin beside filler
            if LATIN.fullmatch(word):
                marked[at - 1 : at + len(word) + 1] = b"\x01" * (len(word) + 2)
            at += len(word) + 1
    for end, (size, kind) in hits:
        if kind == "particle" and not filler:
            continue
        marked[end - size - 1 : end + 1] = b"\x01" * (size + 2)
        kinds[kind] = kinds.get(kind, 0) + size
    kinds.pop("companion", None)
    kinds.pop("particle", None)
    share = (sum(marked[1:-1])) / (len(line) - 2)
    if kinds and share >= coverage:
        return max(sorted(kinds), key=kinds.get), share
    return None, share if kinds else 0.0


def _judged(batches: Iterator[pa.RecordBatch], coverage: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        verdict: dict[str, tuple[str | None, float]] = {}  # recurring messages are judged once
        kinds, shares = [], []
        for text in batch.column(1).to_pylist():
            if (v := verdict.get(text)) is None:
                v = verdict[text] = judge(text, coverage)
            kinds.append(v[0])
            shares.append(v[1])
        keep = pa.array(np.array([k is not None for k in kinds], bool))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array(kinds, pa.string()).filter(keep), pa.array(shares, pa.float64()).filter(keep)], ["id", "kind", "coverage"])


def residue(df: DataFrame, id_col: str, text_col: str, *, coverage: float = COVERAGE) -> DataFrame:
    """Rows whose text is residue: id, kind (slot, filler, error, access or script), coverage.

    Null and blank texts and bare missing-value markers are never residue.  Every row is judged by
    itself on its whole text, without a shuffle; repeated rows are all returned, other columns are
    not read, and an empty table gives an empty result.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    kind = rows.schema["id"].dataType.simpleString()
    return spread(rows).mapInArrow(partial(_judged, coverage=coverage), f"id {kind}, kind string, coverage double")
